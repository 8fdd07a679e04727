"""Queries of operators whose input is a model or a score elsewhere, on given figures, so that SQL can say what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import models, semantic, sets, statistics, text_counts
from tessera.plans import learning, relational, texts
from tessera.sources.tables import table


def strict_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with the name of their nation; a nation without a name would be an error."""
    return sets.strictly_looked_up(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", table(spark, d, "nation"), "n_nationkey", "n_name", "nation")


def flagged_popular(spark: SparkSession, d: str) -> DataFrame:
    """The plays of held-out items, and whether the item is among the 100 most popular of the rest."""
    p = relational._plays(spark, d)
    parts = sets.split_by_group(sets.rows_of(p, sets.active(p, "user", 10).select("user"), "user"), "user", ["item"], 0.9)
    held = parts.where("part = 'test'").select("user", "item")
    return sets.flagged(held, models.popular(parts.where("part = 'train'"), 100).select("item"), ["item"], "popular")


def auc_of_given_scores(spark: SparkSession, d: str) -> DataFrame:
    """The mean area under the curve of items recommended by their popularity, against the held-out items of each user."""
    p = relational._plays(spark, d)
    parts = sets.split_by_group(sets.rows_of(p, sets.active(p, "user", 10).select("user"), "user"), "user", ["item"], 0.9)
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    auc = models.held_out_auc(models.popular_for(test.select("user").distinct(), train, 500), test)
    return auc.select(F.round("mean_auc", 9).alias("mean_auc"), F.round("sum_auc", 6).alias("sum_auc"), "users")


def sampled_events(spark: SparkSession, d: str) -> DataFrame:
    return sets.sampled_by_key(table(spark, d, "events"), ["event_id"], 0.1, 7).select("event_id", "value")


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    parts = sets.split_by_hash(table(spark, d, "events").select("event_id", "event_type"), ["event_id"], [0.8, 0.1, 0.1], 3)
    told = [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    return told[0].unionByName(told[1]).unionByName(told[2]).groupBy("part", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "weather").where("obs_month is not null")
    return w.groupBy(F.when(F.col("obs_month") <= 2, F.lit("train")).otherwise(F.lit("test")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("obs_time").alias("begins"), F.max("obs_time").alias("ends"))


def outliers_of_given_centres(spark: SparkSession, d: str) -> DataFrame:
    return models.outliers(relational.kmeans_distance(spark, d), "distance", 1.01)


def costs_of_given_centres(spark: SparkSession, d: str) -> DataFrame:
    c = models.cost_figures(relational.kmeans_distance(spark, d))
    return c.select(F.round("cost", 3).alias("cost"), F.round("mean_distance", 6).alias("mean_distance"))


def _line_costs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.sum(F.col("l_quantity") / F.col("l_linenumber")), 4).alias("cost"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


def elbow_of_given_costs(spark: SparkSession, d: str) -> DataFrame:
    return statistics.elbow(_line_costs(spark, d), "k", "cost", 1.4)


def scores_of_given_runs(spark: SparkSession, d: str) -> DataFrame:
    return statistics.ranked_scores(_line_costs(spark, d), ["k"], {"cost": 1.0, "price": 0.5})


def best_of_each_type(spark: SparkSession, d: str) -> DataFrame:
    """The creature of the greatest total in each first type: the arg-max over a local score."""
    p = relational._pokemon(spark, d).where("type1 is not null and size(pokemon_stats) = 6 and not exists(pokemon_stats, x -> x is null)")
    total = F.aggregate("pokemon_stats", F.lit(0), lambda a, x: a + x)
    best = p.select("type1", "pokemon_id", total.alias("total")).groupBy("type1").agg(F.max_by("pokemon_id", F.struct("total", -F.col("pokemon_id"))).alias("pokemon_id"), F.max("total").alias("total"))
    return best


def accuracy_of_given_rule(spark: SparkSession, d: str) -> DataFrame:
    """Shares of right predictions for each class and in all, of a fixed rule for the status of an order."""
    o = table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_totalprice") > 250_000, F.lit("F")).when(F.col("o_totalprice") > 100_000, F.lit("O")).otherwise(F.lit("P")).alias("guess"))
    right = F.avg((F.col("o_orderstatus") == F.col("guess")).cast("double"))
    by = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(right, 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return by.unionByName(o.agg(F.lit("all").alias("status"), F.round(right, 9).alias("accuracy"), F.count(F.lit(1)).alias("n")))


def query_vector(spark: SparkSession, d: str) -> DataFrame:
    """The terms of a query that are in the vocabulary, with their weight."""
    return semantic.query_terms(texts._idf(spark, d), ["the", "river", "notaword", "of"]).withColumn("weight", F.round("weight", 9))


_QUERY = ((0, 2.0), (5, -1.0), (9, 0.5))


def _given_concepts(spark: SparkSession, d: str) -> semantic.Concepts:
    """The embeddings as documents over 64 concepts, whose strengths fall, and a term for each concept."""
    docs = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    terms = spark.createDataFrame([(f"t{k}", k, 1.0, [w if j == k else 0.0 for j in range(64)]) for k, w in _QUERY], "term string, term_id int, idf double, v array<double>")
    return semantic.Concepts(docs, terms, [64.0 - k for k in range(64)])


def concept_documents(spark: SparkSession, d: str) -> DataFrame:
    return semantic.top_documents(_given_concepts(spark, d), "vec_id", 5).withColumn("weight", F.round("weight", 6))


def concept_terms(spark: SparkSession, d: str) -> DataFrame:
    return semantic.top_terms(_given_concepts(spark, d), 1).where("weight <> 0")


def concept_labels(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent labels of the ten documents nearest to each concept."""
    top = semantic.top_documents(_given_concepts(spark, d), "vec_id", 10)
    return semantic.top_values(top, table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 2)


def concept_scaled(spark: SparkSession, d: str) -> DataFrame:
    s = semantic.scaled_documents(_given_concepts(spark, d), "vec_id")
    return s.select("vec_id", F.round(F.aggregate("us", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def concept_query(spark: SparkSession, d: str) -> DataFrame:
    return semantic.query(_given_concepts(spark, d), "vec_id", [f"t{k}" for k, _ in _QUERY], 25).withColumn("cosine", F.round("cosine", 6))


def creature_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Weight and height of the creatures scaled to 0 .. 1 and the nearest of four given centres."""
    c = learning.scaled_creatures(spark, d)
    fixed = [(k, (x, y)) for k, (x, y) in enumerate(((0.1, 0.1), (0.1, 0.6), (0.6, 0.1), (0.6, 0.6)))]
    return models.nearest(c, fixed, "v").select("pokemon_id", F.round(F.get("v", F.lit(0)), 9).alias("weight"), F.round(F.get("v", F.lit(1)), 9).alias("height"), "cluster", F.round("distance", 6).alias("distance"))


def lemma_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each lemma stands in the documents."""
    of = text_counts.lemmas(table(spark, d, "documents"), "doc_id", "text", texts.STOP)
    return of.select(F.explode("lemmas").alias("lemma")).groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (strict_lookup, flagged_popular, auc_of_given_scores, sampled_events, split_sizes, temporal_split, outliers_of_given_centres, costs_of_given_centres, elbow_of_given_costs, scores_of_given_runs,
              best_of_each_type, accuracy_of_given_rule, query_vector, concept_documents, concept_terms, concept_labels, concept_scaled, concept_query, creature_scaled, lemma_counts)
}

_TRAIN = relational._PLAYS.format(25) + ", train AS (SELECT * FROM split WHERE part = 'train'), held AS (SELECT \"user\", item FROM split WHERE part = 'test')"
_TOP = ", top AS (SELECT item, sum(rating)::BIGINT AS score FROM train GROUP BY item ORDER BY score DESC, item LIMIT {})\n"
_U = "(('0x' || substr(md5(concat_ws('|', event_id, {})), 1, 8))::BIGINT / 4294967296.0)"
_DISTANCE = "WITH k AS (" + relational.SQL["kmeans_distance"] + ")\n"
_COSTS = "WITH c AS (SELECT l_linenumber AS k, round(sum(l_quantity / l_linenumber), 4) AS cost, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1)\n"
_TOP_DOCS = "WITH each AS (SELECT vec_id, i - 1 AS concept, embedding[i]::DOUBLE AS weight FROM embeddings, range(1, 65) r(i)), top AS (SELECT concept, (row_number() OVER (PARTITION BY concept ORDER BY weight DESC, vec_id))::INT AS rank, vec_id, weight FROM each)\n"
_US = "list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (65 - i))"
_Q = "list_transform(range(0, 64), lambda i: CASE i WHEN 0 THEN 2.0::DOUBLE WHEN 5 THEN -1.0 WHEN 9 THEN 0.5 ELSE 0.0 END)"
SQL = {
    "strict_lookup": "SELECT s_suppkey, s_nationkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "flagged_popular": _TRAIN + _TOP.format(100) + 'SELECT "user", item, (item IN (SELECT item FROM top))::INT AS popular FROM held',
    "auc_of_given_scores": _TRAIN
    + _TOP.format(500)
    + """, pairs AS (SELECT u."user", top.item, top.score, (h.item IS NOT NULL)::INT AS label FROM (SELECT DISTINCT "user" FROM held) u CROSS JOIN top LEFT JOIN held h ON h."user" = u."user" AND h.item = top.item),
r AS (SELECT "user", label, rank() OVER (PARTITION BY "user" ORDER BY score) + (count(*) OVER (PARTITION BY "user", score) - 1) / 2.0 AS r FROM pairs),
a AS (SELECT "user", (sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc FROM r GROUP BY 1 HAVING sum(label) > 0 AND sum(1 - label) > 0)
SELECT round(avg(auc), 9) AS mean_auc, round(sum(auc), 6) AS sum_auc, count(*) AS users FROM a""",
    "sampled_events": f"SELECT event_id, value FROM events WHERE {_U.format(7)} < 0.1",
    "split_sizes": f"SELECT part, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT event_id, event_type, CASE WHEN {_U.format(3)} < 0.8 THEN 0 WHEN {_U.format(3)} < 0.9 THEN 1 ELSE 2 END AS part FROM events) GROUP BY 1, 2",
    "temporal_split": "SELECT CASE WHEN obs_month <= 2 THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(obs_time) AS begins, max(obs_time) AS ends FROM weather WHERE obs_month IS NOT NULL GROUP BY 1",
    "outliers_of_given_centres": _DISTANCE + "SELECT * FROM k WHERE distance >= 1.01 * (SELECT avg(distance) FROM k)",
    "costs_of_given_centres": _DISTANCE + "SELECT round(sum(distance * distance), 3) AS cost, round(avg(distance), 6) AS mean_distance FROM k",
    "elbow_of_given_costs": _COSTS
    + """, f AS (SELECT k, cost, coalesce(lag(cost) OVER (ORDER BY k) > cost * 1.4, TRUE) AS ok FROM c), g AS (SELECT k, cost, bool_and(ok) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS held FROM f)
SELECT k, cost FROM g WHERE held ORDER BY k DESC LIMIT 1""",
    "scores_of_given_runs": _COSTS + "SELECT k, cost, price, (30 - 3 * (row_number() OVER (ORDER BY cost, k) - 1)) * 1.0::DOUBLE + (30 - 3 * (row_number() OVER (ORDER BY price, k) - 1)) * 0.5::DOUBLE AS score FROM c",
    "best_of_each_type": relational._POKE + "SELECT type1, arg_max(pokemon_id, (strength, -pokemon_id)) AS pokemon_id, max(strength)::INT AS total FROM s JOIN (SELECT pokemon_id AS k, pokemon_stats FROM p) ON pokemon_id = k WHERE type1 IS NOT NULL AND len(pokemon_stats) = 6 GROUP BY 1",
    "accuracy_of_given_rule": """WITH o AS (SELECT o_orderstatus AS status, CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END AS guess FROM orders)
SELECT status, round(avg((status = guess)::INT), 9) AS accuracy, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'all', round(avg((status = guess)::INT), 9), count(*) FROM o""",
    "query_vector": texts._TF + "SELECT term, term_id, round(idf, 9) AS weight FROM weighted WHERE term IN ('the', 'river', 'notaword', 'of')",
    "concept_documents": _TOP_DOCS + "SELECT concept::INT AS concept, rank, vec_id, round(weight, 6) AS weight FROM top WHERE rank <= 5",
    "concept_terms": "SELECT * FROM (VALUES (0, 1, 't0', 2.0::DOUBLE), (9, 1, 't9', 0.5::DOUBLE)) t(concept, rank, term, weight)",
    "concept_labels": _TOP_DOCS
    + """, n AS (SELECT concept::INT AS concept, label, count(*) AS n FROM top JOIN embeddings USING (vec_id) WHERE rank <= 10 AND label IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY concept ORDER BY n DESC, label))::INT AS rank FROM n) WHERE rank <= 2""",
    "concept_scaled": f"SELECT vec_id, round(list_sum({_US}), 4) AS total FROM embeddings",
    "concept_query": f"SELECT vec_id, round(list_dot_product(s, q) / sqrt(list_dot_product(s, s) * list_dot_product(q, q)), 6) AS cosine FROM (SELECT vec_id, {_US} AS s, {_Q} AS q FROM embeddings) ORDER BY cosine DESC, vec_id LIMIT 25",
    "creature_scaled": relational._POKE
    + """, w AS (SELECT pokemon_id, weight, height FROM p WHERE weight IS NOT NULL AND height IS NOT NULL AND len(pokemon_stats) = 6 AND len(list_filter(pokemon_stats, lambda x: x IS NULL)) = 0),
n AS (SELECT pokemon_id, (weight - (SELECT min(weight) FROM w)) / (SELECT max(weight) - min(weight) FROM w) AS x, (height - (SELECT min(height) FROM w)) / (SELECT max(height) - min(height) FROM w) AS y FROM w),
c AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE, 0.1::DOUBLE), (1, 0.1, 0.6), (2, 0.6, 0.1), (3, 0.6, 0.6)) t(cluster, cx, cy)),
d AS (SELECT pokemon_id, x, y, cluster, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS dist FROM n, c)
SELECT pokemon_id, round(any_value(x), 9) AS weight, round(any_value(y), 9) AS height, arg_min(cluster, (dist, cluster)) AS cluster, round(min(dist), 6) AS distance FROM d GROUP BY 1""",
    "lemma_counts": texts.LEMMA_COUNTS,
}
