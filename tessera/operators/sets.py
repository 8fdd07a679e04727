"""Lookups, semi- and anti-joins, splits by group, top-k, unions, and grouped figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looked_up(df: DataFrame, key: str, names: DataFrame, name_key: str, name_value: str) -> DataFrame:
    """``df`` with ``key`` replaced where ``names`` has it, else as it is. Null keys of ``names`` name nothing; of several values
    of a key the least counts. The planner broadcasts ``names`` where its size allows."""
    once = names.where(F.col(name_key).isNotNull() & F.col(name_value).isNotNull()).groupBy(F.col(name_key).alias("__k")).agg(F.min(name_value).alias("__v"))
    return df.join(once, F.col(key) == F.col("__k"), "left").withColumn(key, F.coalesce("__v", F.col(key))).drop("__k", "__v")


def strictly_looked_up(df: DataFrame, key: str, names: DataFrame, name_key: str, name_value: str, value: str) -> DataFrame:
    """``df`` with ``value`` from ``names``; a key without a name fails the query when it is read."""
    joined = df.join(names.select(F.col(name_key).alias("__k"), F.col(name_value).alias("__v")), F.col(key) == F.col("__k"), "left")
    checked = F.when(F.col("__v").isNotNull(), F.col("__v")).otherwise(F.raise_error(F.concat(F.lit("no name for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.withColumn(value, checked).drop("__k", "__v")


def active(df: DataFrame, key: str, least: int, distinct: str | None = None) -> DataFrame:
    """(key, n): keys with at least ``least`` rows, or different values of ``distinct``."""
    n = F.count_distinct(distinct) if distinct else F.count(F.lit(1))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("n")).where(F.col("n") >= least)


def rows_of(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def rows_not_of(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """(n): how many values of ``a`` are in ``b``."""
    return a.select(on).distinct().join(b.select(on), on, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def flagged(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str = "held") -> DataFrame:
    """``df`` with 1 or 0 for whether its row is in ``keys``."""
    return df.join(keys.select(*on).distinct().withColumn(flag, F.lit(1)), list(on), "left").fillna(0, [flag])


def split_by_group(df: DataFrame, group: str, order: Sequence[str], share: float = 0.9) -> DataFrame:
    """``df`` with part ``train`` for the first floor(share * n) rows of each group in the given order, else ``test``."""
    w = Window.partitionBy(group)
    first = F.row_number().over(w.orderBy(*order)) <= F.floor(F.lit(share) * F.count(F.lit(1)).over(w))
    return df.withColumn("part", F.when(first, F.lit("train")).otherwise(F.lit("test")))


def uniform(keys: Sequence[str], seed: int) -> Column:
    """A number from 0 to before 1 for each row, by a hash of its keys: the same whatever the partitions, the engine and the run."""
    told = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))
    return F.conv(F.substring(told, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def split_by_hash(df: DataFrame, keys: Sequence[str], weights: Sequence[float], seed: int = 0) -> list[DataFrame]:
    """Parts by a hash of the keys: the same rows whatever the partitions, unlike ``randomSplit``."""
    at, out, low, total = uniform(keys, seed), [], 0.0, float(sum(weights))
    for k, x in enumerate(weights):
        high = low + x / total
        out.append(df.where((at >= low) & (F.lit(True) if k == len(weights) - 1 else at < high)))
        low = high
    return out


def sampled(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Each row with the given chance, by its place in the partitions."""
    return df.sample(False, fraction, seed)


def sampled_by_key(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    """Each row with the given chance, by a hash of its keys, so that a sample can be taken again."""
    return df.where(uniform(keys, seed) < fraction)


def top_rows(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: str, k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


def united_counts(df: DataFrame, columns: Sequence[str], value: str = "value") -> DataFrame:
    """(value, n): how often a value stands in any of the columns; nulls and empty texts do not count."""
    each = df.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias(value))
    return each.where((F.col(value) != "") & F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def pair_key_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of unordered pairs, the lesser first."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).agg(F.count(F.lit(1)).alias("n"))


def summed(df: DataFrame, keys: Sequence[str], value: Column, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def listed(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The values of each group, sorted. For groups that fit a row."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def stats(value: str | Column) -> list[Column]:
    """count, mean, population deviation, max, min and sum, as mergeable aggregates."""
    x = F.col(value) if isinstance(value, str) else value
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stdev"), F.max(x).alias("max"), F.min(x).alias("min"), F.sum(x).alias("sum")]


def described(df: DataFrame, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*stats(value))


def filled(df: DataFrame, column: str, other: Column) -> DataFrame:
    """A column whose nulls and empty texts come from another source."""
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), other))


def valid_rows(df: DataFrame, non_negative: Sequence[str] = (), within: dict[str, tuple] | None = None, any_of: Sequence[str] = ()) -> DataFrame:
    """Rows whose counts are not negative, whose values lie in their range (both ends included) and of whose ``any_of`` texts at least
    one is there. A null count or value is not valid; a text is there if it is not null and not blank."""
    ok = F.lit(True)
    for c in non_negative:
        ok = ok & F.coalesce(F.col(c) >= 0, F.lit(False))
    for c, (low, high) in (within or {}).items():
        ok = ok & F.coalesce(F.col(c).between(F.lit(low), F.lit(high)), F.lit(False))
    if any_of:
        ok = ok & F.exists(F.array(*(F.col(c).cast("string") for c in any_of)), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return df.where(ok)
