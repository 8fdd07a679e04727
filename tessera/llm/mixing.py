"""Mixing sources to target weights.

Texts are encoded, packed into blocks of a fixed number of tokens per source, and drawn into output shards: each shard draws its
source counts from a multinomial, each slot goes through a keyed pseudorandom permutation of its source's block numbers, and
blocks are joined by number. A source is walked at most ``max_repeats`` times: where that does not reach its share, its weight in
the draws is what it has, so that it is spread evenly over the shards, and the report shows what is short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable, known
from tessera.llm import bpe

PART_TEXTS, PART_TOKENS = 50_000, 20_000_000  # of a part of a source, about; parts are numbered on their own
MOST_SOURCES = 10_000  # rows of the target table that the driver takes; more is an error


@dataclass(frozen=True)
class MixRules:
    """block_tokens: tokens of a block. shard_blocks: slots of an output shard. seed: of the draws and permutations.

    total_tokens: wanted size of the mix; None is the size of all texts that take part. What sources are short of their shares is
    not filled up by others.
    """

    block_tokens: int = 256
    shard_blocks: int = 64
    seed: int = 17
    total_tokens: int | None = None


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 at ``index``: a four-round Feistel network, walked until it falls inside."""
    if size <= 1:
        return np.zeros_like(index)
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = np.random.default_rng(key).integers(1, 2**63, 4, dtype=np.uint64)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in rounds:
            h = (right + r) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            left, right = right, left ^ (h & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= np.uint64(size)]
    return x.astype(np.int64)


def packed_blocks(tokens: DataFrame, block_tokens: int, part_texts: int = PART_TEXTS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(source, block, n_tokens, ids): the token lists of each source end to end, cut into blocks; only a source's last is shorter.

    ``tokens`` holds (doc_id, source, ids) without empty lists. Texts are numbered within parts of a source, as many as its texts and
    tokens need, and the parts by their sums, so no task orders more than a part.
    """
    sizes = durable(tokens.groupBy("source").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("ids").cast("bigint")).alias("n")))
    parts = sizes.select("source", F.ceil(F.greatest(F.col("c") / part_texts, F.col("n") / part_tokens, F.lit(1.0))).cast("int").alias("parts"))
    t = tokens.join(known(parts), "source").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("n", F.size("ids").cast("bigint")).drop("parts")
    sums = t.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("source", "part", before.alias("start"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("source", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = t.withColumn("own", own).join(starts, ["source", "part"]).select("source", "ids", "n", (F.col("start") + F.col("own")).alias("at"))
    size = F.lit(block_tokens)
    first, last = F.expr(f"at div {block_tokens}"), F.expr(f"(at + n - 1) div {block_tokens}")
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * size - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * size - F.col("at"), F.col("n"))
    cut = pieces.select("source", "block", (F.col("at") + begin).alias("at"), F.slice("ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("ids"))
    blocks = cut.groupBy("source", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return blocks.select("source", "block", F.size("ids").alias("n_tokens"), "ids")


class Mix:
    """The mix of ``docs`` (key, text, source) after ``targets`` (source, target_share, max_repeats).

    Texts without a source, of a source without a target, null and empty texts take no part. Texts that are the same count once,
    under their least id, so that no text is used more often than its source's ``max_repeats``, whatever its copies. Targets with
    a null source, a null or non-positive share or no repeats are reported with nothing drawn; shares are taken relative to the
    sum over the sources that hold a text. Repeated sources in ``targets`` are an error. The counts of a source are drawn, so actual
    shares lie around the wanted ones by the spread of a multinomial of as many slots.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", rules: MixRules = MixRules(), tokenizer: str = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"):
        self.rules, self.spark = rules, docs.sparkSession
        self.targets = targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        table = self.targets.limit(MOST_SOURCES + 1).toPandas()
        if len(table) > MOST_SOURCES or table["source"].dropna().duplicated().any():
            raise ValueError("targets must name each source once, and at most MOST_SOURCES of them")
        table = table[table["source"].notna() & (table["target_share"] > 0) & (table["max_repeats"] > 0)]
        wanted = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("source").isin(*table["source"]) & (F.length("text") > 0) & F.col("doc_id").isNotNull())
        # Copies fall away before anything is encoded.
        once = wanted.groupBy(F.md5("text").alias("digest")).agg(F.min(F.struct("doc_id", "source", "text")).alias("t")).select("t.*")
        # Written once: sizes, packing and report read the tokens again.
        self.tokens = durable(bpe.encode(once, "text", "ids", tokenizer))
        sizes = {r["source"]: r["n"] for r in self.tokens.groupBy("source").agg(F.sum(F.size("ids").cast("bigint")).alias("n")).collect()}
        table["size"] = table["source"].map(sizes).fillna(0).astype(np.int64)
        self.table = table[table["size"] > 0].sort_values("source", ignore_index=True)
        share = (self.table["target_share"] / self.table["target_share"].sum()).to_numpy(dtype=float)
        size = self.table["size"].to_numpy(dtype=np.int64)
        total = int(size.sum()) if rules.total_tokens is None else rules.total_tokens
        self.wanted = dict(zip(self.table["source"], (share * total).astype(np.int64).tolist()))
        self.blocks = -(-size // rules.block_tokens)
        self.most = self.blocks * self.table["max_repeats"].to_numpy(dtype=np.int64)
        slots = np.minimum(share * (total // rules.block_tokens), self.most)
        self.slots = int(slots.sum() + 1e-6)
        self.weight = slots / max(slots.sum(), 1e-12)

    def drawn(self) -> DataFrame:
        """(shard, slot, source, block, pass): one row for each filled slot, without the tokens."""
        rules, weight, slots, names, n_blocks, most = self.rules, self.weight, self.slots, self.table["source"].tolist(), self.blocks.tolist(), self.most.tolist()
        shards = -(-slots // rules.shard_blocks)

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for shard in pdf["id"]:
                    n = min(rules.shard_blocks, slots - shard * rules.shard_blocks)
                    counts = np.random.default_rng([rules.seed, shard]).multinomial(n, weight)
                    out += [(shard, s, int(c)) for s, c in enumerate(counts) if c > 0]
                yield pd.DataFrame(out, columns=["shard", "s", "n"])

        counts = self.spark.range(shards).mapInPandas(draw, "shard long, s int, n int")
        # Two levels of prefix sums, so that no task numbers all shards of a source.
        grouped = counts.withColumn("part", F.expr("shard div 4096"))
        sums = grouped.groupBy("s", "part").agg(F.sum("n").alias("m"))
        starts = sums.select("s", "part", F.coalesce(F.sum("m").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        own = F.coalesce(F.sum("n").over(Window.partitionBy("s", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = grouped.withColumn("own", own).join(starts, ["s", "part"]).select("shard", "s", "n", (F.col("start") + F.col("own")).alias("k"))

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                n = pdf["n"].to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                s, shard, k = pdf["s"].to_numpy()[row], pdf["shard"].to_numpy()[row], pdf["k"].to_numpy()[row] + step
                turn, block = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
                keep = np.zeros(len(row), dtype=bool)
                for j in np.unique(s):
                    at = np.flatnonzero(s == j)
                    at = at[k[at] < most[j]]
                    keep[at] = True
                    turn[at] = k[at] // n_blocks[j]
                    for p in np.unique(turn[at]):
                        of = at[turn[at] == p]
                        block[of] = permuted(k[of] % n_blocks[j], n_blocks[j], rules.seed * 1_000_003 + int(j) * 1009 + int(p))
                yield pd.DataFrame({"shard": shard[keep], "source": np.array(names, dtype=object)[s[keep]] if names else [], "block": block[keep], "pass": turn[keep].astype(np.int32), "k": k[keep]})

        filled = numbered.mapInPandas(fill, "shard long, source string, block long, pass int, k long")
        # The slots of a shard are mixed, not sorted by source.
        slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("source", "k", F.lit(rules.seed)), "source", "k")) - 1
        return filled.select("shard", slot.alias("slot"), "source", "block", "pass")

    def rows(self) -> DataFrame:
        """(shard, slot, source, block, pass, n_tokens, ids): the mix."""
        return self.drawn().join(packed_blocks(self.tokens, self.rules.block_tokens), ["source", "block"]).select("shard", "slot", "source", "block", "pass", "n_tokens", "ids")

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, size_tokens, mixed_tokens, short_tokens, most_uses, max_repeats) of each target;
        short_tokens is what its texts, repeated as often as they may be, lack of its share of the wanted size."""
        b = self.rules.block_tokens
        sizes = self.tokens.groupBy("source").agg(F.sum(F.size("ids").cast("bigint")).alias("size_tokens"))
        used = self.drawn().groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
        used = used.join(sizes, "source").groupBy("source").agg(
            F.sum(F.col("uses") * F.least(F.lit(b), F.col("size_tokens") - F.col("block") * b)).alias("mixed_tokens"), F.max("uses").alias("most_uses")
        )
        wanted = self.spark.createDataFrame(list(self.wanted.items()), "source string, wanted bigint")
        out = self.targets.join(sizes, "source", "left").join(used, "source", "left").join(wanted, "source", "left")
        mixed, size = F.coalesce("mixed_tokens", F.lit(0)), F.coalesce("size_tokens", F.lit(0))
        total = F.sum(mixed).over(Window.partitionBy(F.lit(1)))  # as many rows as targets
        short = F.greatest(F.coalesce("wanted", F.lit(0)) - size * F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("bigint")
        return out.select(
            "source", "target_share", F.when(total > 0, mixed / total).otherwise(F.lit(0.0)).alias("actual_share"), size.alias("size_tokens"),
            mixed.alias("mixed_tokens"), short.alias("short_tokens"), F.coalesce("most_uses", F.lit(0)).cast("int").alias("most_uses"), "max_repeats",
        )
