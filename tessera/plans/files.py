"""Queries that write a table, read it back and use it: readers, writers and caches. Files go to the shared checkpoint folder."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sinks
from tessera.durable import durable, removed, scratch
from tessera.functions import text as T
from tessera.functions import times
from tessera.operators import models, sets, text_counts
from tessera.plans import texts
from tessera.sources import readers
from tessera.sources.tables import table
from tessera.streaming import counts


def _dumped(spark: SparkSession, d: str) -> tuple[str, str]:
    """Two folders of text files: regions and nations, a tuple on each line."""
    place = scratch(spark, "dump")
    sinks.dumped(table(spark, d, "region").select("r_regionkey", "r_name"), f"{place}/region")
    sinks.dumped(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{place}/nation")
    return f"{place}/region", f"{place}/nation"


def text_from_folders(spark: SparkSession, d: str) -> DataFrame:
    return readers.text_lines(spark, list(_dumped(spark, d)))


def text_from_joined_paths(spark: SparkSession, d: str) -> DataFrame:
    return readers.text_lines(spark, ",".join(_dumped(spark, d)))


def text_from_pattern(spark: SparkSession, d: str) -> DataFrame:
    return readers.text_lines(spark, _dumped(spark, d)[0].replace("/region", "/*"))


def fields_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines without the header line, cut at commas."""
    place = scratch(spark, "header")
    sinks.delimited(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), place, header=True)
    lines = readers.without_header(readers.text_lines(spark, place), "value", "n_nationkey,n_name,n_regionkey")
    return readers.split_fields(lines, "value", ",", [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")])


def records_from_one_file(spark: SparkSession, d: str) -> DataFrame:
    """Records of two lines, written in order to one file and stitched from its numbered lines."""
    place = scratch(spark, "stitched")
    record = F.concat(F.lit("1990,"), F.col("c_custkey"), F.lit(',"'), F.col("c_name"), F.lit("\n"), F.col("c_mktsegment"), F.lit('"'))
    table(spark, d, "customer").select("c_custkey", record.alias("value")).coalesce(1).sortWithinPartitions("c_custkey").select("value").write.text(place)
    lines = readers.text_lines(spark, place).coalesce(1).withColumn("n", F.monotonically_increasing_id())  # one file, one partition: its order
    return readers.stitched_records(lines, "value", "n", block_lines=1000).select("value")


def whole_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Key, tab and value in a folder for each region; the files read whole."""
    place = scratch(spark, "whole")
    sinks.by_class(table(spark, d, "nation").select("n_name", "n_nationkey", "n_regionkey"), place, "n_regionkey")
    files = readers.whole_files(spark, f"{place}/*")
    region = F.regexp_extract("path", r"n_regionkey=([0-9]+)", 1).cast("int")
    line = files.select(region.alias("region"), F.explode(F.split("value", "\n")).alias("line")).where("line <> ''")
    return line.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("line")), ";").alias("lines"))


def class_files(spark: SparkSession, d: str) -> DataFrame:
    """Counts of words and of numbers, each class in a folder of its own."""
    place = scratch(spark, "classes")
    sinks.by_class(text_counts.class_counts(text_counts.lines_of(table(spark, d, "documents"), "text")).select("token", "n", "token_class"), place)
    parts = [readers.split_fields(readers.text_lines(spark, f"{place}/token_class={c}"), "value", "\t", [("token", "string"), ("n", "bigint")]).withColumn("token_class", F.lit(c)) for c in ("word", "number")]
    return parts[0].unionByName(parts[1])


_ORDER = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    place = scratch(spark, "inferred")
    sinks.delimited(table(spark, d, "orders").select(*_ORDER), place, header=True)
    o = readers.csv_table(spark, place)
    return o.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", "o_totalprice")


def csv_given_schema(spark: SparkSession, d: str) -> DataFrame:
    """A single file with a header, read with the schema of what was written."""
    place, o = scratch(spark, "given"), table(spark, d, "orders").select(*_ORDER)
    sinks.delimited(o, place, header=True, single_file=True)
    return readers.csv_table(spark, place, o.schema)


def parquet_by_status(spark: SparkSession, d: str) -> DataFrame:
    place = scratch(spark, "parquet")
    sinks.columnar(table(spark, d, "orders").select(*_ORDER), place, ["o_orderstatus"])
    return spark.read.parquet(place).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


def geojson_regions(spark: SparkSession, d: str) -> DataFrame:
    place = scratch(spark, "geojson")
    feature = F.concat(F.lit('{"properties": '), F.to_json(F.struct("zone_id", "borough")), F.lit(', "geometry": '), F.col("boundary"), F.lit("}"))
    few = table(spark, d, "zones").where("boundary is not null and zone_id is not null").select(feature.alias("f")).agg(F.array_join(F.array_sort(F.collect_list("f")), ",\n").alias("f"))  # one document
    few.select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "f", F.lit("]}"))).coalesce(1).write.text(place)
    of = readers.geojson_features(spark, place)
    return of.select(F.col("properties")["zone_id"].alias("zone_id"), F.col("properties")["borough"].alias("borough"), F.get_json_object("geometry", "$.type").alias("kind"))


def local_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two local lists put together, as a table."""
    return readers.from_rows(spark, [(k, w) for k, w in enumerate(["red", "green", *["blue", None]])], "k int, w string")


def stopword_table(spark: SparkSession, d: str) -> DataFrame:
    return text_counts.stopwords(table(spark, d, "region"), texts.STOP)


def built_once_counts(spark: SparkSession, d: str) -> DataFrame:
    """A count that is built at the first reading and read from its cache at the second."""
    place = scratch(spark, "cache")
    build = lambda: table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    readers.built_once(spark, place, ["events"], build)
    return readers.built_once(spark, place, ["events"], build)


def counts_by_two_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A count written by one job and ordered by another; the files between them are removed."""
    place = scratch(spark, "between")
    sinks.columnar(table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), place)
    out = durable(sets.top_rows(spark.read.parquet(place), 1000, F.desc("n"), "o_custkey"))
    removed(spark, place)
    return out


def costs_file(spark: SparkSession, d: str) -> DataFrame:
    """A small table as one file of ``k,cost`` lines for a plot."""
    place = scratch(spark, "costs")
    costs = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("cost"))
    sinks.delimited(costs, place, single_file=True)
    return readers.csv_table(spark, place, "k int, cost double", header=False)


def saved_features(spark: SparkSession, d: str) -> DataFrame:
    """Index, one-hot and scaled features of orders by a pipeline that was fitted, saved and loaded."""
    place = scratch(spark, "model")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").dropna()
    sinks.model(Pipeline(stages=models.feature_stages(["o_orderpriority"], ["o_totalprice"], "o_orderstatus")).fit(o), place)
    of = PipelineModel.load(place).transform(o)
    x = vector_to_array("features")
    hot = F.transform(vector_to_array("o_orderpriority__hot"), lambda v: v.cast("int"))
    return of.select("o_orderkey", F.col("label").cast("int").alias("label"), F.col("o_orderpriority__index").cast("int").alias("category"), F.array_join(hot.cast("array<string>"), "").alias("hot"), F.round(F.get(x, F.size(x) - 1), 8).alias("price"))


def valid_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), (F.col("value") - 5).alias("value"), F.nullif("event_type", F.lit("error")).alias("a"), F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("x")).alias("b"))
    return sets.valid_rows(e, ["value"], {"day": (dt.date(2024, 1, 3), dt.date(2024, 1, 20))}, ["a", "b"]).select("event_id", F.col("day").cast("string").alias("day"))


def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    """Dates, times of day and timestamps from texts, some of them none."""
    bad = F.col("event_id") % 11 == 0
    e = table(spark, d, "events").select(
        "event_id",
        F.when(bad, F.lit("13/45/2024")).otherwise(F.date_format("ts", "MM/dd/yyyy")).alias("date"),
        F.when(bad, F.lit("25:00")).otherwise(F.date_format("ts", "H:mm")).alias("time"),
        F.when(bad, F.lit("never")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("stamp"),
    )
    return e.select("event_id", times.parsed_date(F.col("date")).cast("string").alias("day"), T.padded_time(F.col("time")).alias("padded"), F.coalesce(times.minutes_of_day(F.col("time")), F.lit(-1)).alias("minutes"), times.parsed_timestamp(F.col("stamp")).alias("stamp"))


def letter_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of letters only, longer than two, joined for each document in their order."""
    words = F.filter(T.tokens(F.col("text")), lambda x: T.letters_only(x) & (F.length(x) > 2))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(words, " ").alias("words"), T.joined([F.col("lang"), F.col("source")], "/").alias("origin"))


def stream_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each micro-batch of a stream of events counted as an action of the driver; the counts of all batches."""
    place = scratch(spark, "batches")
    stream = counts.file_stream(spark, f"{d}/events.parque?", table(spark, d, "events").schema)

    def act(batch: DataFrame, k: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{place}/batch={k}")

    counts.each_batch(stream, act, f"{place}-state").awaitTermination()
    removed(spark, f"{place}-state")
    return spark.read.schema("event_type string, n bigint").parquet(place).groupBy("event_type").agg(F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (text_from_folders, text_from_joined_paths, text_from_pattern, fields_of_lines, records_from_one_file, whole_file_lines, class_files, csv_inferred, csv_given_schema, parquet_by_status,
              geojson_regions, local_rows, stopword_table, built_once_counts, counts_by_two_jobs, costs_file, saved_features, valid_events, parsed_times, letter_tokens, stream_batches)
}

_BOTH = "SELECT concat_ws(',', r_regionkey, r_name) AS value FROM region UNION ALL SELECT concat_ws(',', n_nationkey, n_name, n_regionkey) FROM nation"
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
SQL = {
    "text_from_folders": _BOTH,
    "text_from_joined_paths": _BOTH,
    "text_from_pattern": _BOTH,
    "fields_of_lines": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "records_from_one_file": "SELECT '1990,' || c_custkey || ',\"' || c_name || chr(10) || c_mktsegment || '\"' AS value FROM customer",
    "whole_file_lines": "SELECT n_regionkey AS region, count(*) AS n, string_agg(l, ';' ORDER BY l) AS lines FROM (SELECT n_regionkey, n_name || chr(9) || n_nationkey AS l FROM nation) GROUP BY 1",
    "class_files": texts._LINES + "SELECT token, count(*) AS n, c AS token_class FROM low WHERE c IS NOT NULL GROUP BY 1, 3",
    "csv_inferred": _ORDERS,
    "csv_given_schema": _ORDERS,
    "parquet_by_status": "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1",
    "geojson_regions": "SELECT zone_id, borough, json_extract_string(boundary, '$.type') AS kind FROM zones WHERE boundary IS NOT NULL AND zone_id IS NOT NULL",
    "local_rows": "SELECT * FROM (VALUES (0, 'red'), (1, 'green'), (2, 'blue'), (3, NULL)) t(k, w)",
    "stopword_table": "SELECT DISTINCT unnest([" + texts._STOPPED + "]) AS token",
    "built_once_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "counts_by_two_jobs": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 1000",
    "costs_file": "SELECT l_linenumber AS k, round(sum(l_quantity), 2) AS cost FROM lineitem GROUP BY 1",
    "saved_features": """
WITH o AS (SELECT * FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL),
s AS (SELECT o_orderstatus, (row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1)::INT AS label FROM o GROUP BY 1),
p AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1)::INT AS category FROM o GROUP BY 1)
SELECT o_orderkey, label, category, array_to_string(list_transform(range((SELECT count(*) FROM p) + 1), lambda i: CASE WHEN i = category THEN '1' ELSE '0' END), '') AS hot,
  round(o_totalprice / (SELECT stddev_samp(o_totalprice) FROM o), 8) AS price FROM o JOIN s USING (o_orderstatus) JOIN p USING (o_orderpriority)""",
    "valid_events": "SELECT event_id, ts::DATE::VARCHAR AS day FROM events WHERE value - 5 >= 0 AND ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND (event_type <> 'error' OR event_id % 3 <> 0)",
    "parsed_times": """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN ts::DATE::VARCHAR END AS day, CASE WHEN event_id % 11 = 0 THEN '25:00' ELSE strftime(ts, '%H:%M') END AS padded,
  CASE WHEN event_id % 11 <> 0 THEN hour(ts) * 60 + minute(ts) ELSE -1 END::INT AS minutes, CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) END AS stamp FROM events""",
    "letter_tokens": r"SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '\p{L}+') AND length(x) > 2), ' ') AS words, concat_ws('/', lang, source) AS origin FROM documents WHERE text IS NOT NULL",
    "stream_batches": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
