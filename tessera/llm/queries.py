"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, clusters, cooccur, distinctive, lookalike, mixing
from tessera.operators import sets
from tessera.sources.tables import table


def _clusters(spark: SparkSession, d: str) -> clusters.Clusters:
    return clusters.Clusters(table(spark, d, "pokemon").select("pokemon_id", "pokemon_stats", "pokemon_effectiveness"), "pokemon_id", [("pokemon_stats", 6), ("pokemon_effectiveness", 18)])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).members()


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).described()


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    held = sets.looked_up(table(spark, d, "ratings").select("user_id", "product"), "product", table(spark, d, "artist_alias"), "bad_id", "good_id")
    return cooccur.item_pairs(held, "user_id", "product", min_support=20, min_lift=10.0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("item_a").alias("product_a"), F.col("item_b").alias("product_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.most_distinctive(table(spark, d, "films"), "film_id", "plot")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.tf_idf(table(spark, d, "films"), "film_id", "plot").withColumn("score", F.round("score", 9))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"), "text")


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    # A blank or null text is a class of its own here, so that every row has one.
    return lookalike.consistent_form(table(spark, d, "documents"), "doc_id", "text").withColumn("class_id", F.coalesce("class_id", "doc_id"))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p3_found": p3_found, "p3_pairs": p3_pairs, "p6_found": p6_found, "p6_scores": p6_scores, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_forms": p10_forms}

_HELD = """
WITH names AS (SELECT bad_id, min(good_id) AS good_id FROM artist_alias WHERE bad_id IS NOT NULL AND good_id IS NOT NULL GROUP BY bad_id),
held AS (
  SELECT DISTINCT user_id AS u, coalesce(good_id, product) AS i FROM ratings LEFT JOIN names ON product = bad_id
  WHERE user_id IS NOT NULL AND product IS NOT NULL
), total AS (SELECT count(DISTINCT u) AS n FROM held), one AS (SELECT i, count(*) AS n_i FROM held GROUP BY i),
two AS (SELECT a.i AS a, b.i AS b, count(*) AS n_ab FROM held a JOIN held b ON a.u = b.u AND a.i < b.i GROUP BY a.i, b.i HAVING count(*) >= 20),
full_table AS (
  SELECT a, b, n_ab, x.n_i AS n_a, y.n_i AS n_b, n FROM two JOIN one x ON a = x.i JOIN one y ON b = y.i, total
  WHERE n_ab * n >= 10 * x.n_i * y.n_i
), scored AS (
  SELECT *, greatest(0, 2 * (
    n_ab * ln(n_ab) + (CASE WHEN n_a > n_ab THEN (n_a - n_ab) * ln(n_a - n_ab) ELSE 0 END) + (CASE WHEN n_b > n_ab THEN (n_b - n_ab) * ln(n_b - n_ab) ELSE 0 END)
    + (CASE WHEN n > n_a + n_b - n_ab THEN (n - n_a - n_b + n_ab) * ln(n - n_a - n_b + n_ab) ELSE 0 END)
    - n_a * ln(n_a) - (CASE WHEN n > n_a THEN (n - n_a) * ln(n - n_a) ELSE 0 END) - n_b * ln(n_b) - (CASE WHEN n > n_b THEN (n - n_b) * ln(n - n_b) ELSE 0 END) + n * ln(n))) AS llr
  FROM full_table
)
"""
_SCORES = r"""
WITH once AS (SELECT film_id, max(plot) AS plot FROM films WHERE film_id IS NOT NULL AND plot IS NOT NULL GROUP BY film_id),
cut AS (SELECT film_id, list_transform(regexp_extract_all(plot, '\p{L}+'), lambda x: lower(x)) AS w FROM once),
counts AS (SELECT film_id, len(w) AS n_terms, term, count(*) AS tf FROM cut, unnest(w) AS t(term) GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
scored AS (
  SELECT film_id, counts.term, tf, n_terms, df, tf / n_terms * (ln((1.0 + (SELECT count(*) FROM once)) / (1.0 + df)) + 1.0) AS score
  FROM counts JOIN spread ON counts.term = spread.term
)
"""
SQL = {
    "p3_found": _HELD + "SELECT a AS product_a, b AS product_b FROM scored WHERE llr >= 10.83",
    "p3_pairs": _HELD + "SELECT a AS product_a, b AS product_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b), 6) AS lift, round(llr, 4) AS llr FROM scored WHERE llr >= 10.83",
    "p6_found": _SCORES + "SELECT film_id, arg_min(term, (-score, df, term)) AS term FROM scored WHERE n_terms >= 20 GROUP BY film_id",
    "p6_scores": _SCORES + "SELECT film_id, term, tf, n_terms::INT AS n_terms, df, round(score, 9) AS score FROM scored",
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FROM, _TO = lookalike._table()
_INVISIBLE = r"[\p{Cf}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{034F}\x{FE00}-\x{FE0F}]"
_LOOKS = rf"""
WITH told AS (
  SELECT doc_id, text, md5(text) AS digest, nfc_normalize(translate(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text),
    '({lookalike._PICTURE}\x{{FE0F}}?)\x{{200D}}({lookalike._PICTURE})', '\1{lookalike.JOINED}\2', 'g'), '\r\n?', chr(10), 'g'), '{_INVISIBLE}', '', 'g'), {_text(_FROM)}, {_text(_TO)})) AS looks
  FROM documents WHERE text IS NOT NULL AND NOT regexp_full_match(text, '[\s\p{{Z}}\p{{Cf}}\p{{Cc}}\x{{FE00}}-\x{{FE0F}}]*')
), heads AS (SELECT looks, min(doc_id) AS class_id FROM told GROUP BY looks)
"""
SQL |= {
    "p10_found": _LOOKS
    + f""", texts AS (
  SELECT looks, digest, count(*) AS copies, min(doc_id) AS rep FROM told GROUP BY looks, digest
), classes AS (
  SELECT looks, (sum(copies) * sum(copies) - sum(copies * copies)) / 2 AS pairs, min(rep) AS class_id, arg_min(digest, rep) AS head
  FROM texts GROUP BY looks HAVING count(*) > 1
), seconds AS (
  SELECT c.*, (SELECT min(rep) FROM texts t WHERE t.looks = c.looks AND t.rep <> c.class_id) AS second FROM classes c
)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM told a JOIN told b ON a.looks = b.looks AND a.doc_id < b.doc_id AND a.digest <> b.digest
JOIN classes c ON c.looks = a.looks WHERE c.pairs <= {lookalike.FULL}
UNION
SELECT least(doc_id, o), greatest(doc_id, o) FROM (
  SELECT t.doc_id, CASE WHEN t.digest = c.head THEN c.second ELSE c.class_id END AS o FROM told t JOIN seconds c ON c.looks = t.looks WHERE c.pairs > {lookalike.FULL})""",
    "p10_forms": _LOOKS
    + """SELECT d.doc_id, coalesce(h.class_id, d.doc_id) AS class_id, coalesce(f.text, d.text) AS form FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN heads h ON h.looks = t.looks
LEFT JOIN documents f ON f.doc_id = h.class_id""",
}
