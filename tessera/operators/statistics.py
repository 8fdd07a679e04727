"""Correlations, contingency tables, errors and curves of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import SMALL_ROWS, durable
from tessera.functions import numeric


RANGES = 256


def with_total_before(df: DataFrame, order: str, value: str, before: str, descending: bool = False, by: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows, or those of the same ``by``, whose ``order`` comes before a row's own. Each
    number stands once in ``order`` (for a ``by``); ``by`` holds few different whole numbers.

    Rows are cut into ranges at approximate quantiles, which decide only how even the ranges are; sums run within a range and over
    the ranges, so no task orders all rows.
    """
    df = durable(df)  # read for the quantiles, the sums of ranges and the rows
    shares = [k / RANGES for k in range(1, RANGES)]
    group = F.col(by) if by else F.lit(0)
    found = df.groupBy(group.cast("int").alias("g")).agg(F.percentile_approx(F.col(order).cast("double"), shares, 10_000).alias("c")).collect()
    cuts = {r["g"]: sorted({float(c) for c in r["c"] or []}) for r in found}
    of = F.get(F.lit([cuts.get(g) or [float("inf")] for g in range(max(cuts, default=0) + 1)]), group)
    ranged = df.withColumn("__range", F.size(F.filter(of, lambda c: c < F.col(order))))
    way = F.desc if descending else F.asc
    keys = [by, "__range"] if by else ["__range"]
    ahead = Window.partitionBy(*([by] if by else [])).orderBy(way("__range")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    start = ranged.groupBy(*keys).agg(F.sum(value).alias("__sum")).select(*keys, F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__start"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__own", own).join(F.broadcast(start), keys).withColumn(before, F.col("__start") + F.col("__own")).drop("__range", "__own", "__start")


def mean_ranks(df: DataFrame, columns: Sequence[str], key: str, few: int = SMALL_ROWS) -> DataFrame:
    """(key, columns): ranks of each number column from 1, ties at the mean of their places.

    Ranks come from counts of the distinct values of all columns at once, so only these are ordered, range by range. Up to ``few``
    values are looked up by broadcasts, all columns in one stage; of more the commonest thousand of each column are, so that the
    shuffled lookup of the rest meets no value that many rows hold.
    """
    columns = list(columns)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("x")) for k, c in enumerate(columns)))).alias("e")
    n = df.select(each).select("e.c", "e.x").where("x is not null").groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))
    ranks = durable(with_total_before(n, "x", "n", "before", by="c").select("c", "x", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("r")))
    out = df.select(key, *columns)
    small = ranks.count() <= few
    for k, c in enumerate(columns):
        mine = ranks.where(F.col("c") == k)
        value = F.col(c).cast("double")
        if small:
            out = out.join(F.broadcast(mine.select(F.col("x").alias("__x"), F.col("r").alias(f"__{k}"))), value == F.col("__x"), "left").drop("__x")
            continue
        hot = mine.orderBy(F.desc("n"), "x").limit(1000).select(F.col("x").alias("__x"), F.col("r").alias("__hot"))
        led = out.join(F.broadcast(hot), value == F.col("__x"), "left").drop("__x")
        # Rows that the broadcast served, and nulls, take keys of their own through the join.
        own = F.when(F.col("__hot").isNull() & value.isNotNull(), value.cast("string")).otherwise(F.concat(F.lit("\x00"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(*columns).cast("string")))
        rest = mine.select(F.col("x").cast("string").alias("__on"), F.col("r").alias("__rest"))
        out = led.withColumn("__on", own).join(rest, "__on", "left").withColumn(f"__{k}", F.coalesce("__hot", "__rest")).drop("__on", "__hot", "__rest")
    return out.select(key, *(F.col(f"__{k}").alias(c) for k, c in enumerate(columns)))


def spearman(df: DataFrame, key: str, label: str, features: Sequence[str]) -> DataFrame:
    """(feature, rho): rank correlation of each feature with the label over the rows where every column is there."""
    whole = df.select(key, label, *features).dropna()
    ranks = mean_ranks(whole, [label, *features], key)
    row = ranks.agg(*(F.corr(c, label).alias(c) for c in features))
    return row.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in features)), F.array(*features))).alias("feature", "rho"))


def best_feature(rho: DataFrame, by: str = "signed") -> DataFrame:
    """(feature, rho): the greatest positive correlation, or the strongest of either sign with ``by="abs"``; no row if none is
    above 0."""
    x = F.abs("rho") if by == "abs" else F.col("rho")
    return rho.where(x > 0).orderBy(F.desc(x), "feature").limit(1)


def contingency(df: DataFrame, a: str, b: str, width: int = 10) -> DataFrame:
    """(a_bucket, b_bucket, n): all ten by ten buckets of two numbers, with 0 where no row falls."""
    spark = df.sparkSession
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(numeric.bucket_of_ten(F.col(a), width).alias("a_bucket"), numeric.bucket_of_ten(F.col(b), width).alias("b_bucket")).agg(F.count(F.lit(1)).alias("n"))
    ten = spark.range(100).select((F.col("id") / 10).cast("int").alias("a_bucket"), (F.col("id") % 10).cast("int").alias("b_bucket"))
    return ten.join(counts, ["a_bucket", "b_bucket"], "left").fillna(0, ["n"])


def chi_square(table: DataFrame) -> DataFrame:
    """(statistic, degrees): the test of independence of a contingency table over its rows and columns that are not empty."""
    wa, wb, all_ = Window.partitionBy("a_bucket"), Window.partitionBy("b_bucket"), Window.partitionBy(F.lit(1))  # a hundred rows
    of = table.select("a_bucket", "b_bucket", "n", F.sum("n").over(wa).alias("r"), F.sum("n").over(wb).alias("c"), F.sum("n").over(all_).alias("t")).where("r > 0 and c > 0")
    want = F.col("r") * F.col("c") / F.col("t")
    return of.agg(
        F.sum((F.col("n") - want) * (F.col("n") - want) / want).alias("statistic"), ((F.count_distinct("a_bucket") - 1) * (F.count_distinct("b_bucket") - 1)).alias("degrees")
    )


def mean_squared_error(df: DataFrame, label: str, prediction: str) -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"))


def score_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tp, fp, precision, recall) at each different score, where a row counts as positive from the threshold up.

    ``label`` is 0 or 1. Ties share one row. Only the different scores are ordered, range by range.
    """
    n = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n"))
    run = with_total_before(with_total_before(n, "threshold", "p", "tp_before", True), "threshold", "n", "n_before", True)
    positives = n.agg(F.sum("p").alias("s")).first()["s"]
    tp = F.col("tp_before") + F.col("p")
    of = run.select("threshold", tp.alias("tp"), (F.col("n_before") + F.col("n") - tp).alias("fp"), F.lit(positives).cast("bigint").alias("positives"))
    return of.select("threshold", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def grouped_auc(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(group, auc): the area under the ROC curve of each group from rank sums, ties at half; groups of one class are left out."""
    w = Window.partitionBy(group).orderBy(score)
    first = F.rank().over(w)
    same = F.count(F.lit(1)).over(Window.partitionBy(group, score))
    of = df.select(group, label, (first + (same - 1) / 2).alias("r"))
    p, n = F.sum(label), F.sum(1 - F.col(label))
    return of.groupBy(group).agg(((F.sum(F.col("r") * F.col(label)) - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0))).alias("auc")).where("auc is not null")


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """(tp, fp, tn, fn, precision, recall, accuracy) at a threshold."""
    yes, true = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.count_if(c)
    of = df.agg(n(yes & true).alias("tp"), n(yes & ~true).alias("fp"), n(~yes & ~true).alias("tn"), n(~yes & true).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return of.select("tp", "fp", "tn", "fn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def ranked_scores(df: DataFrame, name: Sequence[str], metrics: dict[str, float], start: int = 30, step: int = 3) -> DataFrame:
    """(name, score): sum over the metrics, less is better, of (start - step * place) * weight, best first. Places beyond start / step
    count negative."""
    places = [
        (F.lit(start) - step * (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(m, *name)) - 1)) * F.lit(float(w)) for m, w in metrics.items()
    ]
    total = places[0]
    for p in places[1:]:
        total = total + p
    return df.select(*name, *metrics, total.alias("score"))


def elbow(costs: DataFrame, k: str, cost: str, ratio: float) -> DataFrame:
    """(k, cost): the last k, from the least on, whose cost is still undercut: previous > cost * ratio; the search stops at the first
    k that fails. The least k if none holds."""
    w = Window.orderBy(k)
    held = costs.withColumn("ok", F.coalesce(F.lag(cost).over(w) > F.col(cost) * ratio, F.lit(True)))
    run = held.withColumn("failed", F.sum((~F.col("ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("failed = 0").orderBy(F.desc(k)).limit(1).select(k, cost)
