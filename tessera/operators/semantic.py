"""Latent semantic analysis: a truncated singular value decomposition of weighted terms, topics and queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.functions import numeric


@dataclass
class Concepts:
    """documents: (key, u) left singular vectors; terms: (term, term_id, v); values: the singular values."""

    documents: DataFrame
    terms: DataFrame
    values: list[float]


def _added(df: DataFrame, size: int, tasks: int) -> np.ndarray:
    """The sum of (a) arrays of ``size``, one from each of ``tasks`` tasks: sixteen go to one, step by step, and the last here."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            for x in pdf["a"]:
                total += np.frombuffer(x)
        yield pd.DataFrame({"a": [total.tobytes()]})

    while tasks > 16:
        tasks = -(-tasks // 16)
        df = df.repartition(tasks).mapInPandas(add, "a binary")
    return sum((np.frombuffer(r[0]) for r in df.collect()), np.zeros(size))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, matrix): some documents at a time as a dense matrix over the terms they hold, from columns i and w."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("i"))
        ends = lists.offsets.to_numpy().astype(np.int64)
        i, w = lists.flatten().to_numpy(zero_copy_only=False), batch.column(batch.schema.get_field_index("w")).flatten().to_numpy(zero_copy_only=False)
        ends -= ends[0]
        for k in range(0, batch.num_rows, rows):
            last = min(k + rows, batch.num_rows)
            mine = slice(ends[k], ends[last])
            terms, at = np.unique(i[mine], return_inverse=True)
            matrix = np.zeros((last - k, len(terms)))
            matrix[np.repeat(np.arange(last - k), np.diff(ends[k : last + 1])), at] = w[mine]
            yield terms, matrix


def decomposed(weights: DataFrame, key: str, vocab_idf: DataFrame, k: int = 25, passes: int = 8, seed: int = 0) -> Concepts:
    """The ``k`` strongest concepts of (key, term, term_id, weight). Keys are whole numbers.

    Subspace iteration from a random start: a pass multiplies the documents' sparse rows with a block of k + 10 vectors and back, so
    a fit takes ``passes`` + 2 jobs whatever the number of documents. Signs are fixed: in each concept the term of the greatest
    weight by size is positive. What the driver holds is bounded by the vocabulary's size and k.
    """
    spark = weights.sparkSession
    n_terms = vocab_idf.count()
    rows = durable(weights.groupBy(F.col(key).cast("bigint").alias(key)).agg(F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("int").alias("i"), F.col("weight").alias("w")))).alias("r")).select(key, F.transform("r", lambda x: x["i"]).alias("i"), F.transform("r", lambda x: x["w"]).alias("w")))
    tasks = rows.rdd.getNumPartitions()
    width = min(k + 10, n_terms)
    k = min(k, n_terms)

    def through(q: np.ndarray, square: bool) -> np.ndarray:
        """A^T A q, or with ``square`` q^T A^T A q."""
        block = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width) if square else (n_terms, width))
            for terms, matrix in _chunks(batches):
                y = matrix @ block.value[terms]
                if square:
                    total += y.T @ y
                else:
                    total[terms] += matrix.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["a"])

        shape = (width, width) if square else (n_terms, width)
        out = _added(rows.select("i", "w").mapInArrow(run, "a binary"), shape[0] * shape[1], tasks).reshape(shape)
        block.unpersist()
        return out

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0] if n_terms else np.empty((0, 0))
    for _ in range(passes if n_terms else 0):
        q = np.linalg.qr(through(q, False))[0]
    value, vector = np.linalg.eigh(through(q, True)) if n_terms else (np.empty(0), np.empty((0, 0)))
    v = (q @ vector[:, ::-1])[:, :k]
    s = np.sqrt(np.maximum(value[::-1][:k], 0))
    v, s = v[:, s > 1e-12], s[s > 1e-12]
    if v.size:
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    right = spark.sparkContext.broadcast(v / s if v.size else np.zeros((n_terms, 0)))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = [matrix @ right.value[terms] for terms, matrix in _chunks(iter([batch]))]
            flat = np.concatenate(u) if u else np.empty((0, right.value.shape[1]))
            ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], names=[key, "u"])

    documents = rows.mapInArrow(left, f"`{key}` bigint, u array<double>")
    term_vectors = spark.createDataFrame([(j, [float(x) for x in row]) for j, row in enumerate(v)], "term_id int, v array<double>")
    return Concepts(documents, vocab_idf.select("term", F.col("term_id").cast("int").alias("term_id"), "idf").join(term_vectors, "term_id"), [float(x) for x in s])


def top_terms(c: Concepts, n: int = 10) -> DataFrame:
    """(concept, rank, term, weight): the terms of the greatest signed weight in each concept."""
    each = c.terms.select("term", F.posexplode("v").alias("concept", "weight"))
    rank = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("weight"), "term"))
    return each.withColumn("rank", rank).where(F.col("rank") <= n).select("concept", "rank", "term", "weight")


def top_documents(c: Concepts, key: str, n: int = 10) -> DataFrame:
    """(concept, rank, key, weight): the documents of the greatest signed weight in each concept."""
    each = c.documents.select(key, F.posexplode("u").alias("concept", "weight"))
    rank = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("weight"), key))
    return each.withColumn("rank", rank).where(F.col("rank") <= n).select("concept", "rank", key, "weight")


def top_values(documents: DataFrame, attributes: DataFrame, key: str, value: str, n: int = 5, by_concept: bool = True) -> DataFrame:
    """The ``n`` most frequent attribute values of the documents of each concept, or of all documents together."""
    keys = ["concept"] if by_concept else []
    of = documents.select("concept", key).join(attributes.select(key, value), key) if by_concept else attributes
    counts = of.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def scaled_documents(c: Concepts, key: str) -> DataFrame:
    """(key, us): left vectors times the singular values."""
    s = F.lit(c.values)
    return c.documents.select(key, F.zip_with("u", s, lambda a, b: a * b).alias("us"))


def query_terms(vocab_idf: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(term, term_id, weight): the terms of a query that are in the vocabulary, each with its idf."""
    return vocab_idf.where(F.col("term").isin(list(terms))).select("term", "term_id", F.col("idf").alias("weight"))


def query(c: Concepts, key: str, terms: Sequence[str], n: int = 25) -> DataFrame:
    """(key, cosine): the documents nearest to the query, whose terms weigh their idf; terms outside the vocabulary count nothing."""
    wanted = c.terms.where(F.col("term").isin(list(terms))).select("idf", "v")  # at most as many rows as the query has terms
    q = np.zeros(len(c.values))
    for r in wanted.collect():
        q += r["idf"] * np.array(r["v"])
    cos = numeric.cosine(F.col("us"), F.lit([float(x) for x in q]))
    return scaled_documents(c, key).select(key, cos.alias("cosine")).where("cosine is not null").orderBy(F.desc("cosine"), key).limit(n)
