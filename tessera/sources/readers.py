"""Readers: text, delimited, fixed-width, whole files, GeoJSON, and caches of a derived table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value): lines of one path, several, a comma-joined list or a glob. Blank lines stay."""
    return spark.read.text(paths.split(",") if isinstance(paths, str) else list(paths))


def whole_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, file, value): each file as one row, with its full path and bare name."""
    df = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, multiline: bool = True) -> DataFrame:
    """A CSV table; quotes are removed, records may hold line breaks, a doubled quote stands for one. Without a schema the types are
    inferred, which reads the data once more."""
    reader = spark.read.option("header", header).option("multiLine", multiline).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def split_fields(df: DataFrame, line: str, sep: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns of a line cut at ``sep`` (a regex), each (name, type); what does not parse is null."""
    parts = F.split(F.col(line), sep, -1)
    return df.select(*(F.get(parts, F.lit(k)).try_cast(t).alias(c) for k, (c, t) in enumerate(fields)))


def quoted_fields(line: Column, sep: str = ",") -> Column:
    """The fields of a line cut at the character ``sep`` outside quotes; quotes are removed. An open quote goes on to the end of the
    line. The line is walked once, however many separators it has."""
    field = rf'(?:[^"\Q{sep}\E]|"[^"]*+(?:"|\z))*+'
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf"\Q{sep}\E({field})"), F.lit(1))
    return F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, r'(?s)\A"(.*)"\z', "$1"), '""', '"'))


def without_header(df: DataFrame, line: str, header: str) -> DataFrame:
    """Lines other than the header line; prefer ``csv_table`` with a header."""
    return df.where(~F.col(line).eqNullSafe(F.lit(header)))


def stitched_records(df: DataFrame, line: str, number: str, file: str | None = None, starts: str = r"\A[0-9]{4},", block_lines: int = 100_000) -> DataFrame:
    """(file, record, value): physical lines put together to records that begin at a line matching ``starts``.

    ``number`` is the whole number of a line, or its offset, in the order of its file. Lines before the first start of a file make no
    record. Give ``file`` to keep the numbering within a file. Starts are counted in blocks of ``block_lines`` numbers and over the
    blocks, so one large file is many tasks.
    """
    key = F.col(file) if file else F.lit("")
    base = df.select(key.alias("file"), F.col(number).cast("bigint").alias("n"), F.col(line).alias("value"))
    placed = base.withColumn("block", F.floor(F.col("n") / block_lines)).withColumn("start", F.coalesce(F.col("value").rlike(starts), F.lit(False)).cast("int"))
    before = F.sum("s").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    sums = placed.groupBy("file", "block").agg(F.sum("start").alias("s")).select(F.col("file").alias("f"), "block", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.sum("start").over(Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    led = placed.withColumn("own", own).join(sums.withColumnRenamed("block", "b"), F.col("file").eqNullSafe(F.col("f")) & (F.col("block") == F.col("b")))
    at = led.select("file", "n", "value", (F.col("own") + F.col("before")).alias("record"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n")
    return at.where("record > 0").groupBy("file", "record").agg(joined.alias("value"))


@dataclass(frozen=True)
class Slice:
    """A fixed-width field: from ``start`` (0-based) to before ``end``, divided by ``scale``."""

    name: str
    start: int
    end: int
    type: str = "int"
    scale: float | None = None


# Offsets of the hourly weather records.
WEATHER_SLICES = (
    Slice("obs_year", 15, 19), Slice("obs_month", 19, 21), Slice("obs_day", 21, 23), Slice("obs_hour", 23, 25),
    Slice("latitude", 28, 34, "double", 1000), Slice("longitude", 34, 41, "double", 1000), Slice("elevation_dimension", 46, 51),
    Slice("direction_angle", 60, 63), Slice("speed_rate", 65, 69, "double", 10), Slice("ceiling_height_dimension", 70, 75),
    Slice("distance_dimension", 78, 84), Slice("dew_point_temperature", 93, 98, "double", 10),
    Slice("air_temperature", 87, 92, "double", 10),
)
# What stands for a missing value, by field, before scaling.
WEATHER_MISSING = {"direction_angle": 999, "speed_rate": 9999, "ceiling_height_dimension": 99999, "distance_dimension": 999999, "dew_point_temperature": 9999}


def fixed_width(df: DataFrame, line: str, slices: Sequence[Slice] = WEATHER_SLICES, keep: Sequence[str] = ()) -> DataFrame:
    """The fields of fixed-width lines; a field that does not parse is null."""

    def cut(s: Slice) -> Column:
        raw = F.substring(F.col(line), s.start + 1, s.end - s.start)
        x = F.trim(raw).try_cast("double" if s.scale else s.type)
        return (x / s.scale if s.scale else x).cast(s.type).alias(s.name)

    return df.select(*keep, *(cut(s) for s in slices))


def weather_records(df: DataFrame, line: str, drop_sentinels: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Hourly weather records whose air temperature is measured (not ``+9999``). Other fields keep their sentinels as values, or
    become null there with ``drop_sentinels``."""
    out = fixed_width(df.where(F.substring(F.col(line), 88, 5) != "+9999"), line, WEATHER_SLICES, keep)
    if drop_sentinels:
        scale = {s.name: s.scale or 1 for s in WEATHER_SLICES}
        out = out.withColumns({c: F.when(F.col(c) != v / scale[c], F.col(c)) for c, v in WEATHER_MISSING.items()})
    return out


def safely_parsed(df: DataFrame, line: str, parsers: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows all of whose parsers give a value, with these columns, and the others with the names of what failed.

    ``parsers`` are expressions that are null where the text does not parse (``try_cast``, ``try_to_timestamp``).
    """
    tried = df.withColumns({f"__{k}": v for k, v in parsers.items()})
    failed = F.array_compact(F.array(*(F.when(F.col(f"__{k}").isNull(), F.lit(k)) for k in parsers)))
    good = tried.where(F.size(failed) == 0).select(*(F.col(f"__{k}").alias(k) for k in parsers))
    return good, tried.where(F.size(failed) > 0).select(F.col(line), F.concat_ws(",", failed).alias("failed"))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry): the features of a GeoJSON document, the geometry as JSON text."""
    doc = spark.read.text(path, wholetext=True)
    feature = F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f")
    return doc.select(feature).select(F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"), F.get_json_object("f", "$.geometry").alias("geometry"))


def from_rows(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """A local collection as a table, with a given schema."""
    return spark.createDataFrame(list(rows), schema)


def built_once(spark: SparkSession, folder: str, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes, written under a name made of ``inputs`` and read from there; built only where it is not yet."""
    path = f"{folder}/{hashlib.sha256(repr(sorted(inputs)).encode()).hexdigest()[:24]}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
