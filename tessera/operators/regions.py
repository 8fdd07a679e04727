"""The region of a point, and figures of trips by region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric, times
from tessera.operators import sets
from tessera.operators.places import points_at_places, polygons


def region_table(zones: DataFrame, name: str, code: str, region: str, boundary: str) -> DataFrame:
    """(name, region, priority, boundary): regions with what orders them, the code and then the falling area. No task orders all.

    A null or unreadable boundary has no area and contains nothing.
    """
    import numpy as np
    import pandas as pd

    def areas(batches):
        for pdf in batches:
            out = []
            for b in pdf["boundary"]:
                total = 0.0
                for rings in polygons(b):
                    for k, r in enumerate(rings):
                        x, y = r[:, 0], r[:, 1]
                        a = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
                        total += a if k == 0 else -a
                out.append(total)
            yield pd.DataFrame(pdf.assign(area=out))

    base = zones.select(F.col(name).cast("string").alias("name"), F.col(region).cast("string").alias("region"), F.col(code).cast("int").alias("code"), F.col(boundary).alias("boundary"))
    sized = base.mapInPandas(areas, "name string, region string, code int, boundary string, area double")
    return sized.withColumn("priority", F.struct("code", (-F.col("area")).alias("smaller"), "name"))


def region_of(points: DataFrame, keys: list[str], lon: str, lat: str, regions: DataFrame) -> DataFrame:
    """(keys, region): for each point in any region the region of the first in priority that contains it."""
    hits = points_at_places(points, keys, lon, lat, zones=regions.select("name", "boundary"), place="name")
    return hits.join(regions.select("name", "region", "priority"), "name").groupBy(*keys).agg(F.min_by("region", "priority").alias("region"))


def clean_trips(trips: DataFrame, most_hours: int = 3) -> DataFrame:
    """Trips of 0 to below ``most_hours`` whole hours with no end at (0, 0); a null or NaN coordinate stays."""
    hours = times.whole_hours(F.col("dropoff_time"), F.col("pickup_time"))
    at_zero = lambda a, b: F.coalesce((F.col(a) == 0) & (F.col(b) == 0), F.lit(False))
    return trips.where((hours >= 0) & (hours < most_hours) & ~at_zero("pickup_lon", "pickup_lat") & ~at_zero("dropoff_lon", "dropoff_lat"))


def with_regions(trips: DataFrame, regions: DataFrame, key: str = "trip_id") -> DataFrame:
    """Trips with ``pickup_region`` and ``dropoff_region``, null where no region contains the end. One pass over both ends."""
    ends = trips.select(key, F.expr("stack(2, 'pickup', pickup_lon, pickup_lat, 'dropoff', dropoff_lon, dropoff_lat) as (trip_end, lon, lat)"))
    found = region_of(ends, [key, "trip_end"], "lon", "lat", regions)
    both = found.groupBy(key).agg(
        F.max(F.when(F.col("trip_end") == "pickup", F.col("region"))).alias("pickup_region"), F.max(F.when(F.col("trip_end") == "dropoff", F.col("region"))).alias("dropoff_region")
    )
    return trips.join(both, key, "left")


def trip_minutes() -> Column:
    return times.whole_minutes(F.col("dropoff_time"), F.col("pickup_time"))


def same_region() -> Column:
    """Both ends in one region; two ends in no region count as the same."""
    return F.col("pickup_region").eqNullSafe(F.col("dropoff_region"))


def duration_stats(trips: DataFrame, keys: list[str | Column] = ()) -> DataFrame:
    """Figures of the non-negative durations in whole minutes."""
    return sets.described(trips.withColumn("minutes", trip_minutes()).where("minutes >= 0"), "minutes", keys)


def duration_per_metre_by_hour(trips: DataFrame, compat: bool = False) -> DataFrame:
    """(hour, n, seconds_per_metre): mean of duration over great-circle distance by hour of the pickup; not finite ones are left out."""
    dist = numeric.haversine_m(*(F.col(c) for c in ("pickup_lon", "pickup_lat", "dropoff_lon", "dropoff_lat")), compat=compat)
    ratio = F.try_divide(times.whole_seconds(F.col("dropoff_time"), F.col("pickup_time")).cast("double"), dist)
    of = trips.select(F.hour("pickup_time").alias("hour"), ratio.alias("r")).where(numeric.finite(F.col("r")))
    return of.groupBy("hour").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("seconds_per_metre"))
