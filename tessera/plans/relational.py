"""Queries of lookups, splits, grouped figures, statistics and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric, times
from tessera.functions import text as T
from tessera.operators import models, sessions, sets, statistics
from tessera.sources.tables import table


def danger_top25(spark: SparkSession, d: str) -> DataFrame:
    s = sets.summed(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"], F.col("l_quantity"), "total")
    return sets.top_rows(s, 25, F.desc("total"), "l_suppkey", "l_returnflag", "l_linestatus")


def factor_top5(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return sets.top_rows(sets.united_counts(flags, ["a", "b"], "factor"), 5, F.desc("n"), "factor")


def danger_dow_hour(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"day": times.day_name(F.col("ts")), "hour": F.hour("ts")})
    s = e.groupBy("day", "hour").agg(F.round(F.sum("value"), 3).alias("total"), F.count(F.lit(1)).alias("n"))
    return s


def vehicle_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the customer's and the supplier's nation over all order lines, the lesser key first."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    both = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return sets.pair_key_counts(both, "a", "b")


def abs_diff(spark: SparkSession, d: str) -> DataFrame:
    x = F.abs(F.col("l_quantity") - F.col("l_linenumber") * 10)
    return sets.top_rows(sets.summed(table(spark, d, "lineitem"), ["l_suppkey"], x, "difference"), 25, F.desc("difference"), "l_suppkey")


def signed_diff(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_quantity") - F.col("l_linenumber") * 10
    return sets.top_rows(sets.summed(table(spark, d, "lineitem"), ["l_suppkey"], x, "difference"), 25, F.desc("difference"), "l_suppkey")


def _plays(spark: SparkSession, d: str) -> DataFrame:
    """(user, item, rating): plays of each user and artist, alias ids replaced; null or negative plays and null ids are left out."""
    r = table(spark, d, "ratings").where("user_id is not null and product is not null and rating > 0").select("user_id", "product", "rating")
    r = sets.looked_up(r, "product", table(spark, d, "artist_alias"), "bad_id", "good_id")
    return r.groupBy(F.col("user_id").alias("user"), F.col("product").alias("item")).agg(F.sum("rating").cast("bigint").alias("rating"))


def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = sets.looked_up(table(spark, d, "ratings").select("product").where("product is not null"), "product", table(spark, d, "artist_alias"), "bad_id", "good_id")
    return r.groupBy("product").agg(F.count(F.lit(1)).alias("n"))


def active_users(spark: SparkSession, d: str) -> DataFrame:
    return sets.active(table(spark, d, "ratings"), "user_id", 10, distinct="product")


def user_split_90(spark: SparkSession, d: str) -> DataFrame:
    p = _plays(spark, d)
    kept = sets.rows_of(p, sets.active(p, "user", 10).select("user"), "user")
    return sets.split_by_group(kept, "user", ["item"], 0.9).groupBy("user", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("plays"))


def top25_per_user(spark: SparkSession, d: str) -> DataFrame:
    p = _plays(spark, d)
    kept = sets.rows_of(p, sets.active(p, "user", 10).select("user"), "user")
    return sets.top_per_group(kept, "user", 25, F.desc("rating"), "item")


def popularity(spark: SparkSession, d: str) -> DataFrame:
    return models.popular(_plays(spark, d), 25)


def popularity_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = _plays(spark, d)
    by_users = p.groupBy("item").agg(F.count(F.lit(1)).alias("users")).orderBy(F.desc("users"), "item").limit(100)
    return sets.overlap(models.popular(p, 100), by_users, "item")


def _pokemon(spark: SparkSession, d: str) -> DataFrame:
    """One row for each id: the least of its repeats, column by column."""
    p = table(spark, d, "pokemon")
    rest = [c for c in p.columns if c != "pokemon_id"]
    return p.groupBy("pokemon_id").agg(F.min(F.struct(*rest)).alias("r")).select("pokemon_id", "r.*")


def type_union_count(spark: SparkSession, d: str) -> DataFrame:
    return sets.united_counts(_pokemon(spark, d), ["type1", "type2"], "type")


def strongest_by_type(spark: SparkSession, d: str) -> DataFrame:
    p = _pokemon(spark, d).where("type1 = 'Water' or type2 = 'Water'")
    strength = p.select("pokemon_id", "pokemon_name", numeric.total(F.col("pokemon_stats").cast("array<double>")).cast("bigint").alias("strength")).where("strength is not null")
    return sets.top_rows(strength, 5, F.desc("strength"), "pokemon_id")


def strongest(spark: SparkSession, d: str) -> DataFrame:
    strength = _pokemon(spark, d).select("pokemon_id", "pokemon_name", numeric.total(F.col("pokemon_stats").cast("array<double>")).cast("bigint").alias("strength"))
    return sets.top_rows(strength.where("strength is not null"), 1, F.desc("strength"), "pokemon_id")


def legendary_by_group(spark: SparkSession, d: str) -> DataFrame:
    return sets.listed(_pokemon(spark, d).where("legendary and not mega and generation is not null"), ["generation"], "pokemon_id", "members")


def final_evo_by_group(spark: SparkSession, d: str) -> DataFrame:
    return sets.listed(_pokemon(spark, d).where("final_evo and not mega and not legendary and generation is not null"), ["generation"], "pokemon_id", "members")


def stat_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest of each base value, and the mean after min-max scaling."""
    s = _pokemon(spark, d).where("size(pokemon_stats) = 6").select(F.posexplode("pokemon_stats").alias("stat", "x")).where("x is not null")
    return s.groupBy("stat").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.round(numeric.min_max(F.avg("x"), F.min("x"), F.max("x")), 9).alias("mean_scaled"))


def minmax_normalise(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    r = li.agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")).first()
    return li.select("l_orderkey", "l_linenumber", F.round(numeric.min_max(F.col("l_extendedprice"), F.lit(r["low"]), F.lit(r["high"])), 6).alias("scaled"))


def logit_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.logit_scale(F.col("l_discount") * 10 - F.col("l_quantity") / 10), 6).alias("scaled"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    half = F.reverse(e)
    return table(spark, d, "embeddings").select("vec_id", F.round(numeric.norm(e), 4).alias("length"), F.round(numeric.dot(e, half), 4).alias("dot"), F.round(numeric.cosine(e, half), 4).alias("cosine"), F.round(numeric.distance(e, half), 4).alias("distance"))


_FEATURES = ("obs_hour", "elevation_dimension", "direction_angle", "speed_rate", "dew_point_temperature", "latitude")


def spearman(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "weather").where("abs(air_temperature) < 100 and abs(dew_point_temperature) < 100 and speed_rate < 900 and not isnan(air_temperature)")
    return statistics.spearman(w, "obs_id", "air_temperature", _FEATURES).withColumn("rho", F.round("rho", 8))


def spearman_best(spark: SparkSession, d: str) -> DataFrame:
    return statistics.best_feature(spearman(spark, d))


def mse(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("guess", F.col("l_quantity") * 1000)
    return statistics.mean_squared_error(li, "l_extendedprice", "guess").select(F.round(F.col("mse") / 1e6, 3).alias("mse"), F.round("rmse", 4).alias("rmse"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_suppkey")


def precision_recall_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    c = statistics.score_curve(_scored(spark, d).withColumn("score", F.round("score", 4)), "score", "label")
    return c.select("threshold", "tp", "fp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def confusion_at_half(spark: SparkSession, d: str) -> DataFrame:
    c = statistics.confusion(_scored(spark, d), "score", "label", 0.5)
    return c.select("tp", "fp", "tn", "fn", *(F.round(k, 9).alias(k) for k in ("precision", "recall", "accuracy")))


def auc_by_group(spark: SparkSession, d: str) -> DataFrame:
    a = statistics.grouped_auc(_scored(spark, d).withColumn("score", F.round("score", 4)), "l_suppkey", "score", "label")
    return a.withColumn("auc", F.round("auc", 9))


def _customer_figures(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_orderpriority", "o_orderstatus").alias("kinds"))
    return o


def contingency(spark: SparkSession, d: str) -> DataFrame:
    return statistics.contingency(_customer_figures(spark, d), "orders", "kinds", 3)


def contingency_chi2(spark: SparkSession, d: str) -> DataFrame:
    return statistics.chi_square(contingency(spark, d)).withColumn("statistic", F.round("statistic", 6))


def kmeans_distance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fixed = [(0, [0.1] * 64), (1, [-0.1] * 64), (2, [0.1, -0.1] * 32)]
    return models.nearest(e, fixed, "v").select("vec_id", "cluster", F.round("distance", 5).alias("distance"))


def ego_features(spark: SparkSession, d: str) -> DataFrame:
    names = [f"feature_{k:02d}" for k in range(64)]
    bits = F.transform("embedding", lambda x: (x > 0.15).cast("int"))
    named = table(spark, d, "embeddings").select("vec_id", T.bits_to_names(bits, names).alias("features"))
    return named.select("vec_id", F.array_join("features", ",").alias("features"), F.size("features").alias("n_features"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.sessions(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 4)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))


def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.sessions(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", 4)
    n = sessions.with_next(s, "user_id", "ts", "event_id", ["ts", "event_type"])
    return n.select("event_id", "session", "event_type", "next_event_type", times.whole_minutes(F.col("next_ts"), F.col("ts")).alias("gap_minutes"))


QUERIES = {
    f.__name__: f
    for f in (danger_top25, factor_top5, danger_dow_hour, vehicle_pairs, abs_diff, signed_diff, alias_lookup, active_users, user_split_90, top25_per_user, popularity, popularity_overlap,
              type_union_count, strongest_by_type, strongest, legendary_by_group, final_evo_by_group, stat_ranges, minmax_normalise, logit_scale, vector_norms, spearman, spearman_best, mse,
              precision_recall_by_threshold, confusion_at_half, auc_by_group, contingency, contingency_chi2, kmeans_distance, ego_features, event_sessions, session_gaps)
}

_PLAYS = """
WITH names AS (SELECT bad_id, min(good_id) AS good_id FROM artist_alias WHERE bad_id IS NOT NULL AND good_id IS NOT NULL GROUP BY bad_id),
plays AS (
  SELECT user_id AS "user", coalesce(good_id, product) AS item, sum(rating)::BIGINT AS rating FROM ratings LEFT JOIN names ON product = bad_id
  WHERE user_id IS NOT NULL AND product IS NOT NULL AND rating > 0 GROUP BY 1, 2
), kept AS (SELECT * FROM plays WHERE "user" IN (SELECT "user" FROM plays GROUP BY 1 HAVING count(*) >= 10)),
split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY "user" ORDER BY item) <= floor(0.9 * count(*) OVER (PARTITION BY "user")) THEN 'train' ELSE 'test' END AS part FROM kept),
popular AS (SELECT item, sum(rating)::BIGINT AS score FROM plays GROUP BY item ORDER BY score DESC, item LIMIT {})
"""
_POKE = "WITH p AS (SELECT DISTINCT ON (pokemon_id) * FROM pokemon ORDER BY pokemon_id, pokemon_name NULLS FIRST, type1 NULLS FIRST, type2 NULLS FIRST, pokemon_stats NULLS FIRST, pokemon_effectiveness NULLS FIRST, generation NULLS FIRST, final_evo NULLS FIRST, legendary NULLS FIRST, mega NULLS FIRST, height NULLS FIRST, weight NULLS FIRST), s AS (SELECT pokemon_id, pokemon_name, type1, type2, list_sum(pokemon_stats)::BIGINT AS strength FROM p WHERE len(pokemon_stats) = len(list_filter(pokemon_stats, lambda x: x IS NOT NULL)))\n"
_SCORED = "WITH s AS (SELECT round(l_discount * 10, 4) AS score, (l_returnflag = 'R')::INT AS label, l_suppkey FROM lineitem)\n"
_WEATHER = "WITH w AS (SELECT * FROM weather WHERE abs(air_temperature) < 100 AND abs(dew_point_temperature) < 100 AND speed_rate < 900 AND NOT isnan(air_temperature) AND " + " AND ".join(f"{c} IS NOT NULL" for c in _FEATURES) + "),\n"
_RANKED = _WEATHER + "r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("air_temperature", *_FEATURES)) + " FROM w), rho AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, air_temperature), 8) AS rho FROM r" for c in _FEATURES) + ")\n"
_CUSTOMER = """
WITH f AS (SELECT o_custkey, count(*) AS orders, count(DISTINCT (o_orderpriority, o_orderstatus)) AS kinds FROM orders GROUP BY 1),
b AS (SELECT least(orders // 3, 9)::INT AS a_bucket, least(kinds // 3, 9)::INT AS b_bucket, count(*) AS n FROM f GROUP BY 1, 2),
full_table AS (SELECT x::INT AS a_bucket, y::INT AS b_bucket, coalesce(n, 0) AS n FROM range(10) r(x) CROSS JOIN range(10) s(y) LEFT JOIN b ON a_bucket = x AND b_bucket = y)
"""
_SESSIONS = """
WITH g AS (SELECT *, coalesce(datediff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) >= 14400000000, TRUE) AS starts FROM events),
s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
"""
_E = "embedding::DOUBLE[]"
SQL = {
    "danger_top25": "SELECT l_suppkey, l_returnflag, l_linestatus, sum(l_quantity) AS total FROM lineitem GROUP BY ALL ORDER BY total DESC, 1, 2, 3 LIMIT 25",
    "factor_top5": "SELECT factor, count(*) AS n FROM (SELECT l_returnflag AS factor FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem) WHERE factor <> '' GROUP BY 1 ORDER BY n DESC, factor LIMIT 5",
    "danger_dow_hour": "SELECT dayname(ts) AS day, hour(ts)::INT AS hour, round(sum(value), 3) AS total, count(*) AS n FROM events GROUP BY 1, 2",
    "vehicle_pairs": "SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey IS NOT NULL AND s_nationkey IS NOT NULL GROUP BY 1, 2",
    "abs_diff": "SELECT l_suppkey, sum(abs(l_quantity - l_linenumber * 10)) AS difference FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "signed_diff": "SELECT l_suppkey, sum(l_quantity - l_linenumber * 10) AS difference FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "alias_lookup": _PLAYS.format(25) + "SELECT coalesce(good_id, product) AS product, count(*) AS n FROM ratings LEFT JOIN names ON product = bad_id WHERE product IS NOT NULL GROUP BY 1",
    "active_users": "SELECT user_id, count(DISTINCT product) AS n FROM ratings WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT product) >= 10",
    "user_split_90": _PLAYS.format(25) + 'SELECT "user", part, count(*) AS n, sum(rating)::BIGINT AS plays FROM split GROUP BY 1, 2',
    "top25_per_user": _PLAYS.format(25) + 'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, item)::INT AS rank FROM kept) WHERE rank <= 25',
    "popularity": _PLAYS.format(25) + "SELECT * FROM popular",
    "popularity_overlap": _PLAYS.format(100) + "SELECT count(*) AS n FROM popular WHERE item IN (SELECT item FROM plays GROUP BY item ORDER BY count(*) DESC, item LIMIT 100)",
    "type_union_count": _POKE + "SELECT type, count(*) AS n FROM (SELECT type1 AS type FROM p UNION ALL SELECT type2 FROM p) WHERE type <> '' GROUP BY 1",
    "strongest_by_type": _POKE + "SELECT pokemon_id, pokemon_name, strength FROM s WHERE type1 = 'Water' OR type2 = 'Water' ORDER BY strength DESC, pokemon_id LIMIT 5",
    "strongest": _POKE + "SELECT pokemon_id, pokemon_name, strength FROM s ORDER BY strength DESC, pokemon_id LIMIT 1",
    "legendary_by_group": _POKE + "SELECT generation, list_sort(list(pokemon_id)) AS members FROM p WHERE legendary AND NOT mega AND generation IS NOT NULL GROUP BY 1",
    "final_evo_by_group": _POKE + "SELECT generation, list_sort(list(pokemon_id)) AS members FROM p WHERE final_evo AND NOT mega AND NOT legendary AND generation IS NOT NULL GROUP BY 1",
    "stat_ranges": _POKE + "SELECT (i - 1)::INT AS stat, min(x) AS low, max(x) AS high, round((avg(x) - min(x)) / (max(x) - min(x)), 9) AS mean_scaled FROM (SELECT i, pokemon_stats[i] AS x FROM p, range(1, 7) r(i) WHERE len(pokemon_stats) = 6) WHERE x IS NOT NULL GROUP BY 1",
    "minmax_normalise": "SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) AS scaled FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)",
    "logit_scale": "SELECT l_orderkey, l_linenumber, round(5 / (1 + exp(-(l_discount * 10 - l_quantity / 10))), 6) AS scaled FROM lineitem",
    "vector_norms": f"SELECT vec_id, round(sqrt(list_dot_product(e, e)), 4) AS length, round(list_dot_product(e, h), 4) AS dot, round(list_dot_product(e, h) / list_dot_product(e, e), 4) AS cosine, round(list_distance(e, h), 4) AS distance FROM (SELECT vec_id, {_E} AS e, list_reverse({_E}) AS h FROM embeddings)",
    "spearman": _RANKED + "SELECT * FROM rho",
    "spearman_best": _RANKED + "SELECT * FROM rho WHERE rho > 0 ORDER BY rho DESC, feature LIMIT 1",
    "mse": "SELECT round(avg(pow(l_extendedprice - l_quantity * 1000, 2)) / 1e6, 3) AS mse, round(sqrt(avg(pow(l_extendedprice - l_quantity * 1000, 2))), 4) AS rmse FROM lineitem",
    "precision_recall_by_threshold": _SCORED + "SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / (tp + fp), 9) AS precision, round(tp / all_p, 9) AS recall FROM (SELECT score, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER () AS all_p FROM (SELECT score, sum(label) AS p, count(*) AS n FROM s GROUP BY score) WINDOW w AS (ORDER BY score DESC))",
    "confusion_at_half": "WITH s AS (SELECT l_discount * 10 >= 0.5 AS yes, l_returnflag = 'R' AS t FROM lineitem), c AS (SELECT count(*) FILTER (yes AND t) AS tp, count(*) FILTER (yes AND NOT t) AS fp, count(*) FILTER (NOT yes AND NOT t) AS tn, count(*) FILTER (NOT yes AND t) AS fn FROM s) SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy FROM c",
    "auc_by_group": _SCORED + "SELECT l_suppkey, round((sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 9) AS auc FROM (SELECT l_suppkey, label, rank() OVER (PARTITION BY l_suppkey ORDER BY score) + (count(*) OVER (PARTITION BY l_suppkey, score) - 1) / 2.0 AS r FROM s) GROUP BY 1 HAVING sum(label) > 0 AND sum(1 - label) > 0",
    "contingency": _CUSTOMER + "SELECT * FROM full_table",
    "contingency_chi2": _CUSTOMER + "SELECT round(sum(pow(n - r * c / t, 2) / (r * c / t)), 6) AS statistic, (count(DISTINCT a_bucket) - 1) * (count(DISTINCT b_bucket) - 1) AS degrees FROM (SELECT *, sum(n) OVER (PARTITION BY a_bucket)::DOUBLE AS r, sum(n) OVER (PARTITION BY b_bucket)::DOUBLE AS c, sum(n) OVER ()::DOUBLE AS t FROM full_table) WHERE r > 0 AND c > 0",
    "kmeans_distance": f"WITH e AS (SELECT vec_id, {_E} AS v FROM embeddings), c AS (SELECT 0 AS cluster, list_transform(range(64), lambda i: 0.1::DOUBLE) AS m UNION ALL SELECT 1, list_transform(range(64), lambda i: -0.1::DOUBLE) UNION ALL SELECT 2, list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 0.1::DOUBLE ELSE -0.1 END)) SELECT vec_id, arg_min(cluster, (dist, cluster)) AS cluster, round(min(dist), 5) AS distance FROM (SELECT vec_id, cluster, list_distance(v, m) AS dist FROM e, c) GROUP BY 1",
    "ego_features": "SELECT vec_id, array_to_string(f, ',') AS features, len(f)::INT AS n_features FROM (SELECT vec_id, list_transform(list_filter(range(64), lambda i: embedding[i + 1] > 0.15::DOUBLE), lambda i: 'feature_' || lpad(i::VARCHAR, 2, '0')) AS f FROM embeddings)",
    "event_sessions": _SESSIONS + "SELECT user_id, session, count(*) AS n, min(ts) AS begins, max(ts) AS ends FROM s GROUP BY 1, 2",
    "session_gaps": _SESSIONS + "SELECT * FROM (SELECT event_id, session, event_type, lead(event_type) OVER w AS next_event_type, (datediff('microsecond', ts, lead(ts) OVER w) // 60000000)::BIGINT AS gap_minutes FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id)) WHERE gap_minutes IS NOT NULL",
}
