"""Sessions of a key by gaps in time, and what lies between consecutive rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import times


def sessions(df: DataFrame, key: str, at: str, tie: str, gap_hours: int = 4) -> DataFrame:
    """``df`` with ``session``, numbered from 1 for each key: a new one begins where a row comes ``gap_hours`` whole hours or more
    after the one before it. A gap of exactly that length splits, which a session window would not do.

    Rows are ordered day by day; the last time of the day before and the sessions of all earlier days come from a table of one row
    for each key and day. So a key with a large part of all rows is spread over its days. Rows without a time are left out.
    """
    placed = df.where(F.col(at).isNotNull()).withColumn("__day", F.to_date(at))
    day = Window.partitionBy(key, "__day").orderBy(at, tie)
    days = Window.partitionBy(key).orderBy("__day")
    last = placed.groupBy(key, "__day").agg(F.max(at).alias("__last")).select(F.col(key).alias("__key"), F.col("__day").alias("__d"), F.lag("__last").over(days).alias("__before"))
    same_day = lambda k, d: F.col(key).eqNullSafe(F.col(k)) & (F.col("__day") == F.col(d))
    led = placed.withColumn("__previous", F.lag(at).over(day)).join(last, same_day("__key", "__d")).drop("__key", "__d")
    starts = F.coalesce(times.whole_hours(F.col(at), F.coalesce("__previous", "__before")) >= gap_hours, F.lit(True)).cast("int")
    told = led.withColumn("__starts", starts).drop("__previous", "__before")
    sums = told.groupBy(key, "__day").agg(F.sum("__starts").alias("__s"))
    earlier = sums.select(F.col(key).alias("__key"), F.col("__day").alias("__d"), F.coalesce(F.sum("__s").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    run = F.sum("__starts").over(day.rowsBetween(Window.unboundedPreceding, 0))
    out = told.withColumn("__run", run).join(earlier, same_day("__key", "__d"))
    return out.withColumn("session", F.col("__run") + F.col("__earlier")).select(*df.columns, "session")


def with_next(df: DataFrame, key: str, at: str, tie: str, columns: list[str]) -> DataFrame:
    """Rows of ``sessions`` that have a next one in their session, with ``next_`` columns of it."""
    w = Window.partitionBy(key, "session").orderBy(at, tie)
    return df.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns), F.lead(F.lit(1)).over(w).alias("__has")).where("__has = 1").drop("__has")


def idle(df: DataFrame, keys: list[str], ends: str, begins: str, non_negative: bool = False) -> DataFrame:
    """(keys, n, idle_minutes, mean_minutes): time from the end of a row to the begin of the next one, by ``keys``.

    idle_minutes is the sum in whole minutes, mean_minutes that number divided by n. Negative gaps count unless excluded.
    """
    gap = times.micros(F.col(begins), F.col(ends))
    of = df.withColumn("__gap", gap).where(F.col("__gap").isNotNull())
    if non_negative:
        of = of.where("__gap >= 0")
    total = F.sum("__gap")
    minutes = (F.sign(total) * F.floor(F.abs(total) / 60_000_000)).cast("bigint")
    return of.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), minutes.alias("idle_minutes")).withColumn("mean_minutes", F.col("idle_minutes") / F.col("n"))
