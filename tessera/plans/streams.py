"""Queries that run a stream over files to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table
from tessera.streaming import counts


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # A pattern, as a table may be one file or a folder of them.
    return counts.file_stream(spark, f"{d}/{name}.parque?", table(spark, d, name).schema)


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.run_counts(counts.value_counts(_stream(spark, d, "events"), "event_type", "user_id"), "events")


def stream_hashtag_counts(spark: SparkSession, d: str) -> DataFrame:
    table_ = counts.run_counts(counts.hashtag_counts(_stream(spark, d, "documents"), "text"), "hashtags")
    return table_.orderBy(F.desc("n"), "hashtag").limit(1000)


def stream_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    table_ = counts.run_counts(counts.hashtag_pairs(_stream(spark, d, "documents"), "text"), "pairs")
    return table_.orderBy(F.desc("n"), "a", "b").limit(1000)


def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    of = counts.run_counts(counts.windowed_counts(_stream(spark, d, "events"), "ts", "event_type", "1 day"), "hourly")
    return of.select(F.col("begins").cast("timestamp_ntz").alias("begins"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_event_counts, stream_hashtag_counts, stream_pair_counts, stream_hourly_counts)}
SQL = {
    "stream_event_counts": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_hashtag_counts": r"SELECT hashtag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '#[\p{L}\p{N}_]+'))) AS hashtag FROM documents) GROUP BY hashtag ORDER BY n DESC, hashtag LIMIT 1000",
    "stream_pair_counts": r"""WITH t AS (SELECT list_transform(regexp_extract_all(text, '#[\p{L}\p{N}_]+'), lambda x: lower(x)) AS t FROM documents)
SELECT t[i] AS a, t[j] AS b, count(*) AS n FROM t, unnest(range(1, len(t) + 1)) AS x(i), unnest(range(1, len(t) + 1)) AS y(j) WHERE i < j GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 1000""",
    "stream_hourly_counts": "SELECT date_trunc('day', ts) AS begins, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
