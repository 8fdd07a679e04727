"""How distinctive a term is for a record: term frequency times smoothed logarithmic inverse document frequency.

Counts of distinct (record, term) pairs give the document frequencies, which are written once and joined back: as a broadcast where
the terms are few; else the commonest ``HOT_TERMS`` terms travel as a broadcast of exactly that many rows at most, so the shuffled
join meets no term that a large part of the records holds, and rows that the broadcast served take keys of their own through it and
are spread evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.durable import SMALL_ROWS, durable

HOT_TERMS = 10_000
WORD = r"\p{L}+"


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, n_terms) of each record: runs of letters in lower case, whole texts.

    A key that stands in several rows counts once, by its greatest text. Null keys and texts without a word give no rows.
    """
    once = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__key").isNotNull() & F.col("__text").isNotNull()).groupBy("__key").agg(F.max("__text").alias("__text"))
    words = F.transform(F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)), F.lower)
    # The exchange by key also serves the counts of (key, term).
    cut = once.select("__key", words.alias("w")).select("__key", F.size("w").alias("n_terms"), F.explode("w").alias("term"))
    return cut.groupBy("__key", "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"))


def tf_idf(df: DataFrame, key: str, text: str, hot_terms: int = HOT_TERMS, few_terms: int = SMALL_ROWS) -> DataFrame:
    """(key, term, tf, n_terms, df, score): score = tf / n_terms * (ln((1 + N) / (1 + df)) + 1).

    N is the number of records with a text. The division by the number of terms is the length normalisation: the score of a term
    does not grow with the length of its record. Up to ``few_terms`` different terms travel as a broadcast.
    """
    n = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key).distinct().count()
    counts = term_counts(df, key, text)
    spread = durable(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    score = lambda df: F.col("tf") / F.col("n_terms") * (F.log((1.0 + n) / (1.0 + df)) + 1.0)
    if spread.count() <= few_terms:
        out = counts.join(F.broadcast(spread), "term")
        return out.select(F.col("__key").alias(key), "term", "tf", "n_terms", "df", score(F.col("df")).alias("score"))
    hot = spread.orderBy(F.desc("df"), "term").limit(hot_terms).select("term", F.col("df").alias("hot_df"))
    led = counts.join(F.broadcast(hot), "term", "left")
    own = F.when(F.col("hot_df").isNull(), F.col("term")).otherwise(F.concat(F.lit("\x00"), F.col("__key").cast("string")))
    joined = led.withColumn("__on", own).join(spread.select(F.col("term").alias("__on"), "df"), "__on", "left")
    seen = F.coalesce("hot_df", "df")
    return joined.select(F.col("__key").alias(key), "term", "tf", "n_terms", seen.alias("df"), score(seen).alias("score"))


def most_distinctive(df: DataFrame, key: str, text: str, min_words: int = 20) -> DataFrame:
    """(key, term): the term of the highest score of each record with at least ``min_words`` words; ties go to the rarer term, then
    to the first in order."""
    scored = tf_idf(df, key, text).where(F.col("n_terms") >= min_words)
    return scored.groupBy(key).agg(F.min_by("term", F.struct(-F.col("score"), F.col("df"), F.col("term"))).alias("term"))
