"""Writers. A table is written in parts; one file is for small results and asked for by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_class(df: DataFrame, path: str, cls: str = "token_class") -> None:
    """Key, tab and value, in a folder for each class."""
    df.write.mode("overwrite").partitionBy(cls).option("sep", "\t").csv(path)


def delimited(df: DataFrame, path: str, header: bool = False, sep: str = ",", single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def columnar(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def dumped(df: DataFrame, path: str, sep: str = ",") -> None:
    """Each row as one line of text."""
    df.select(F.concat_ws(sep, *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def model(fitted, path: str) -> None:
    """A fitted model or pipeline of pyspark.ml."""
    fitted.write().overwrite().save(path)
