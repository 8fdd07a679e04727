"""Queries over taxi trips: regions, durations, sessions, idle time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import times
from tessera.operators import regions, sessions, sets
from tessera.plans import problems
from tessera.sources.tables import table


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.region_table(table(spark, d, "zones"), "zone_id", "borough_code", "borough", "boundary")


def _trips(spark: SparkSession, d: str) -> DataFrame:
    return regions.with_regions(regions.clean_trips(table(spark, d, "taxi_trips")), _regions(spark, d))


def _told(df: DataFrame) -> DataFrame:
    return df.withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


def trip_stats_same(spark: SparkSession, d: str) -> DataFrame:
    return _told(regions.duration_stats(_trips(spark, d).where(regions.same_region())))


def trip_stats_diff(spark: SparkSession, d: str) -> DataFrame:
    return _told(regions.duration_stats(_trips(spark, d).where(~regions.same_region())))


def trip_stats_region(spark: SparkSession, d: str) -> DataFrame:
    return _told(regions.duration_stats(_trips(spark, d), ["dropoff_region"]))


def trip_stats_dow(spark: SparkSession, d: str) -> DataFrame:
    t = regions.clean_trips(table(spark, d, "taxi_trips")).withColumn("day", F.date_format("pickup_time", "EEEE"))
    return _told(regions.duration_stats(t, ["day"]))


def region_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _trips(spark, d).groupBy("pickup_region").agg(F.count(F.lit(1)).alias("n"))


def region_fill(spark: SparkSession, d: str) -> DataFrame:
    """A region that is given for a third of the trips, and found from the place of the pickup for the others."""
    given = F.when(F.col("trip_id") % 3 == 0, F.lit("given")).otherwise(F.lit(""))
    t = _trips(spark, d).withColumn("region", given)
    return sets.filled(t, "region", F.col("pickup_region")).select("trip_id", "region")


def hours_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = times.whole_hours(F.col("dropoff_time"), F.col("pickup_time"))
    return table(spark, d, "taxi_trips").where(h.isNotNull()).groupBy(h.alias("hours")).agg(F.count(F.lit(1)).alias("n"))


def norm_duration_by_hour(spark: SparkSession, d: str) -> DataFrame:
    t = regions.clean_trips(table(spark, d, "taxi_trips"))
    return regions.duration_per_metre_by_hour(t).withColumn("seconds_per_metre", F.round("seconds_per_metre", 9))


def _sessions(spark: SparkSession, d: str, regional: bool = False) -> DataFrame:
    t = _trips(spark, d) if regional else regions.clean_trips(table(spark, d, "taxi_trips"))
    return sessions.sessions(t.where("license is not null"), "license", "pickup_time", "trip_id", 4)


def trip_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    return s.groupBy("license", "session").agg(F.count(F.lit(1)).alias("n"), F.min("pickup_time").alias("begins"), F.max("dropoff_time").alias("ends"))


def session_lengths(spark: SparkSession, d: str) -> DataFrame:
    return trip_sessions(spark, d).groupBy(F.col("n").alias("trips")).agg(F.count(F.lit(1)).alias("sessions"))


def _idle(df: DataFrame, keys: list[str]) -> DataFrame:
    n = sessions.with_next(df, "license", "pickup_time", "trip_id", ["pickup_time"]).withColumn("hour", F.hour("dropoff_time"))
    return sessions.idle(n, keys, "dropoff_time", "next_pickup_time").withColumn("mean_minutes", F.round("mean_minutes", 6))


def idle_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return _idle(_sessions(spark, d), ["hour"])


def idle_by_region(spark: SparkSession, d: str) -> DataFrame:
    return _idle(_sessions(spark, d, True), ["dropoff_region"])


def idle_by_region_hour(spark: SparkSession, d: str) -> DataFrame:
    return _idle(_sessions(spark, d, True), ["dropoff_region", "hour"])


QUERIES = {
    f.__name__: f
    for f in (trip_stats_same, trip_stats_diff, trip_stats_region, trip_stats_dow, region_histogram, region_fill, hours_histogram, norm_duration_by_hour, trip_sessions, session_lengths,
              idle_by_hour, idle_by_region, idle_by_region_hour)
}

_ZONES = problems.SQL["p4_found"].split("near AS (")[0].strip().rstrip(",")
_CLEAN = """, usec AS (
  SELECT *, datediff('microsecond', pickup_time, dropoff_time) AS us FROM taxi_trips
), clean AS (
  SELECT *, us // 60000000 AS minutes FROM usec
  WHERE us > -3600000000 AND us < 10800000000 AND NOT coalesce(pickup_lon = 0 AND pickup_lat = 0, FALSE) AND NOT coalesce(dropoff_lon = 0 AND dropoff_lat = 0, FALSE)
)"""
_REGIONS = (
    _ZONES
    + """, ring_areas AS (
  SELECT zone_id, piece, row_number() OVER (PARTITION BY zone_id, piece ORDER BY k) AS k, r FROM (
    SELECT zone_id, piece, i AS k, json_extract(p, '$[' || i || ']')::DOUBLE[][] AS r FROM each_piece, unnest(range(json_array_length(p)::BIGINT)) AS t(i))
), areas AS (
  SELECT zone_id, sum((CASE WHEN k = 1 THEN 1 ELSE -1 END) * abs(list_sum(list_transform(range(1, len(r) + 1), lambda i: r[i][1] * r[i % len(r) + 1][2] - r[i % len(r) + 1][1] * r[i][2]))) / 2) AS area FROM ring_areas GROUP BY 1
), prio AS (
  SELECT zone_id, borough, row_number() OVER (ORDER BY borough_code, area DESC, zone_id) AS priority FROM zones JOIN areas USING (zone_id)
), region AS (
  SELECT trip_id, trip_end, arg_min(borough, priority) AS region FROM (SELECT DISTINCT trip_id, trip_end, place_id FROM inside) JOIN prio ON place_id = zone_id GROUP BY 1, 2
)"""
    + _CLEAN
    + """, t AS (
  SELECT c.*, a.region AS pickup_region, b.region AS dropoff_region FROM clean c
  LEFT JOIN region a ON a.trip_id = c.trip_id AND a.trip_end = 'pickup' LEFT JOIN region b ON b.trip_id = c.trip_id AND b.trip_end = 'dropoff'
)
"""
)
_STATS = "count(minutes) AS n, round(avg(minutes), 6) AS mean, round(stddev_pop(minutes), 6) AS stdev, max(minutes) AS max, min(minutes) AS min, sum(minutes)::BIGINT AS sum"
_PLAIN = "WITH nothing AS (SELECT 1)" + _CLEAN + "\n"


def _with_sessions(base: str, source: str) -> str:
    return (
        base
        + f""", g AS (SELECT *, coalesce(datediff('microsecond', lag(pickup_time) OVER w, pickup_time) >= 14400000000, TRUE) AS starts FROM {source} WHERE license IS NOT NULL WINDOW w AS (PARTITION BY license ORDER BY pickup_time, trip_id)),
s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY license ORDER BY pickup_time, trip_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g),
nx AS (SELECT *, hour(dropoff_time)::INT AS hour, lead(pickup_time) OVER (PARTITION BY license, session ORDER BY pickup_time, trip_id) AS next_pickup FROM s),
gap AS (SELECT *, datediff('microsecond', dropoff_time, next_pickup) AS gap FROM nx WHERE next_pickup IS NOT NULL AND dropoff_time IS NOT NULL)
"""
    )


_IDLE = "SELECT {k}, count(*) AS n, (sign(sum(gap)) * floor(abs(sum(gap)) / 60000000))::BIGINT AS idle_minutes, round((sign(sum(gap)) * floor(abs(sum(gap)) / 60000000)) / count(*), 6) AS mean_minutes FROM gap GROUP BY ALL"
_SESSION = "SELECT license, session, count(*) AS n, min(pickup_time) AS begins, max(dropoff_time) AS ends FROM s GROUP BY 1, 2"
SQL = {
    "trip_stats_same": _REGIONS + f"SELECT {_STATS} FROM t WHERE minutes >= 0 AND pickup_region IS NOT DISTINCT FROM dropoff_region",
    "trip_stats_diff": _REGIONS + f"SELECT {_STATS} FROM t WHERE minutes >= 0 AND pickup_region IS DISTINCT FROM dropoff_region",
    "trip_stats_region": _REGIONS + f"SELECT dropoff_region, {_STATS} FROM t WHERE minutes >= 0 GROUP BY 1",
    "trip_stats_dow": _PLAIN + f"SELECT dayname(pickup_time) AS day, {_STATS} FROM clean WHERE minutes >= 0 GROUP BY 1",
    "region_histogram": _REGIONS + "SELECT pickup_region, count(*) AS n FROM t GROUP BY 1",
    "region_fill": _REGIONS + "SELECT trip_id, CASE WHEN trip_id % 3 = 0 THEN 'given' ELSE pickup_region END AS region FROM t",
    "hours_histogram": "SELECT (sign(us) * floor(abs(us) / 3600000000))::BIGINT AS hours, count(*) AS n FROM (SELECT datediff('microsecond', pickup_time, dropoff_time) AS us FROM taxi_trips) WHERE us IS NOT NULL GROUP BY 1",
    "norm_duration_by_hour": _PLAIN
    + """, r AS (SELECT hour(pickup_time)::INT AS hour, (sign(us) * floor(abs(us) / 1000000)) / nullif(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(dropoff_lat - pickup_lat) / 2), 2)
  + cos(radians(pickup_lat)) * cos(radians(dropoff_lat)) * pow(sin(radians(dropoff_lon - pickup_lon) / 2), 2)))), 0) AS r FROM clean)
SELECT hour, count(*) AS n, round(avg(r), 9) AS seconds_per_metre FROM r WHERE isfinite(r) GROUP BY 1""",
    "trip_sessions": _with_sessions(_PLAIN, "clean") + _SESSION,
    "session_lengths": _with_sessions(_PLAIN, "clean") + f"SELECT n AS trips, count(*) AS sessions FROM ({_SESSION}) GROUP BY 1",
    "idle_by_hour": _with_sessions(_PLAIN, "clean") + _IDLE.format(k="hour"),
    "idle_by_region": _with_sessions(_REGIONS, "t") + _IDLE.format(k="dropoff_region"),
    "idle_by_region_hour": _with_sessions(_REGIONS, "t") + _IDLE.format(k="dropoff_region, hour"),
}
