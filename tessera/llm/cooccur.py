"""Items that appear together: stripes with a log-likelihood ratio.

A stripe is the array of the items met beside one item, with counts. Tasks build stripes over all baskets they read and merge
them before the shuffle; a stripe is cut into segments of neighbours, so no array grows without bound, and the arrays of a segment
are merged by key after it. Items that cannot reach the wanted support or lift in any pair are left out beforehand, which loses no
pair. A basket longer than ``CHUNK`` items is cut into chunks by hash, and each two chunks meet under a key of their own, so the
pairs of one basket are made on many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1024
SEGMENT = 4096
HELD = 3_000_000  # pairs that a task holds before it hands on its stripes

STRIPES = "a int, seg int, nbrs array<int>, cnts array<int>"


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys added up."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], (np.add.reduceat(n, first) if len(first) else n)


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for a pair, the lesser item first."""
    low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
    return (low << 32) | (high & 0xFFFFFFFF)


def _stripes(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    a, b = (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
    seg = np.floor_divide(b, SEGMENT).astype(np.int32)
    order = np.lexsort((b, a))
    a, b, seg, n = a[order], b[order], seg[order], n[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (seg[1:] != seg[:-1])])) if len(a) else np.empty(0, dtype=np.int64)
    ends = pa.array(np.append(first, len(a)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(a[first]), pa.array(seg[first]), pa.ListArray.from_arrays(ends, pa.array(b)), pa.ListArray.from_arrays(ends, pa.array(n))],
        names=["a", "seg", "nbrs", "cnts"],
    )


def _folded(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Stripes of all keys, merged as far as HELD allows."""
    keys, n, waiting, held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [], 0
    for part in parts:
        waiting.append(part)
        held += len(part)
        if held > HELD:
            more = np.concatenate(waiting)
            keys, n = _counted(np.concatenate([keys, more]), np.concatenate([n, np.ones(len(more), dtype=np.int64)]))
            waiting, held = [], 0
            if len(keys) > HELD:
                yield _stripes(keys, n)
                keys, n = keys[:0], n[:0]
    more = np.concatenate([np.empty(0, dtype=np.int64), *waiting])
    keys, n = _counted(np.concatenate([keys, more]), np.concatenate([n, np.ones(len(more), dtype=np.int64)]))
    if len(keys):
        yield _stripes(keys, n)


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat items, lengths) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the pairs inside each list."""

    def parts() -> Iterator[np.ndarray]:
        for batch in batches:
            items, size = _lists(batch.column(0))
            owner = np.repeat(np.arange(len(size)), size)
            for step in range(1, int(size.max(initial=0))):
                same = owner[step:] == owner[:-step]
                yield _key(items[:-step][same], items[step:][same])

    return _folded(parts())


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the pairs between two lists of each row."""

    def parts() -> Iterator[np.ndarray]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                for part in np.array_split(a, max(1, len(a) * len(b) // HELD)):
                    yield _key(np.repeat(part, len(b)), np.tile(b, len(part)))

    return _folded(parts())


def merged(batches: Iterator[pa.RecordBatch], min_support: int) -> Iterator[pa.RecordBatch]:
    """(a, b, n_ab) of at least ``min_support``, from stripes in the order of (a, seg): arrays of a key are added up, and the last key
    of a batch waits for the next one."""

    def told(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        keys, n = keys[n >= min_support], n[n >= min_support]
        b = (keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array(b), pa.array(n)], names=["a", "b", "n_ab"])

    keys, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, size = _lists(batch.column(2))
        own = np.repeat(batch.column(0).to_numpy().astype(np.int64), size)
        keys, n = _counted(np.concatenate([keys, (own << 32) | (flat.astype(np.int64) & 0xFFFFFFFF)]), np.concatenate([n, _lists(batch.column(3))[0].astype(np.int64)]))
        a, seg = batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py()
        last = ((keys >> 32) == a) & (np.floor_divide((keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32), SEGMENT) == seg)
        yield told(keys[~last], n[~last])
        keys, n = keys[last], n[last]
    yield told(keys, n)


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """The G statistic of a pair's two-by-two table."""
    k11, k12, k21 = n_ab.cast("double"), (n_a - n_ab).cast("double"), (n_b - n_ab).cast("double")
    k22 = (n - n_a - n_b + n_ab).cast("double")
    cells = _xlogx(k11) + _xlogx(k12) + _xlogx(k21) + _xlogx(k22)
    rows = _xlogx(n_a.cast("double")) + _xlogx((n - n_a).cast("double"))
    cols = _xlogx(n_b.cast("double")) + _xlogx((n - n_b).cast("double"))
    return F.greatest(F.lit(0.0), 2 * (cells - rows - cols + _xlogx(n.cast("double"))))


def item_pairs(df: DataFrame, basket: str, item: str, min_support: int = 20, min_lift: float = 10.0, min_llr: float = 10.83) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, llr) of the pairs of different items that stand together more than chance has it.

    A pair comes out when at least ``min_support`` baskets hold both, n_ab * n >= min_lift * n_a * n_b, and its log-likelihood
    ratio is at least ``min_llr``. Counts are of distinct baskets; n is the number of baskets with any item. Rows with a null
    basket or item do not count, repeated rows count once, item_a < item_b. Items are integers.
    """
    held = df.select(F.col(basket).alias("u"), F.col(item).cast("int").alias("i")).where(F.col("u").isNotNull() & F.col("i").isNotNull())
    n = held.select("u").distinct().count()
    pairs = held.distinct()
    # No pair of an item reaches the support if the item does not, nor the lift if more than n / lift baskets hold the item.
    items = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n_i")).where((F.col("n_i") >= min_support) & (F.col("n_i") * F.lit(float(min_lift)) <= n))
    kept = pairs.join(items.select("i"), "i", "left_semi")
    large = kept.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CHUNK).select("u", F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks"))
    cut = kept.join(large, "u", "left").select("u", "i", F.coalesce("chunks", F.lit(1)).alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("i"), F.col("chunks")).cast("int"))
    lists = cut.groupBy("u", "chunks", "chunk").agg(F.collect_list("i").alias("items"))
    one = lists.select("items").mapInArrow(within, STRIPES)
    # Each chunk goes to the key of each pair it is in; a key holds two chunks.
    parts = lists.where("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk")
    met = parts.groupBy("u", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2")).agg(F.collect_list("items").alias("l")).where(F.size("l") == 2)
    two = met.select(F.get("l", F.lit(0)).alias("x"), F.get("l", F.lit(1)).alias("y")).mapInArrow(across, STRIPES)
    ordered = one.unionByName(two).repartition("a", "seg").sortWithinPartitions("a", "seg")
    stripes = ordered.mapInArrow(lambda batches: merged(batches, min_support), "a int, b int, n_ab bigint")
    out = stripes.join(items.select(F.col("i").alias("a"), F.col("n_i").alias("n_a")), "a").join(items.select(F.col("i").alias("b"), F.col("n_i").alias("n_b")), "b")
    total = F.lit(n).cast("bigint")
    out = out.where(F.col("n_ab") * total >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    out = out.withColumn("llr", log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), total)).where(F.col("llr") >= min_llr)
    return out.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", total.alias("n"), (F.col("n_ab") * total / (F.col("n_a") * F.col("n_b"))).alias("lift"), "llr")
