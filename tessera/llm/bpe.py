"""Token ids of a byte-level BPE vocabulary for a whole corpus.

Each pre-token is merged with a rank queue over a hierarchical bitmap: bucket r holds the positions of a linked list at which a
pair of rank r starts, three levels of 64-bit words tell the lowest non-empty bucket by find-first-set, and entries that an
earlier merge outdated are skipped when they come up. The work of a pre-token is linear in its merges, so a pre-token of a
megabyte is no special case. Results of short pre-tokens are kept in a bounded table per worker.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEPT_PIECES = 200_000
KEPT_LENGTH = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankBitmap:
    """A set of ranks with find-first, as three levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << ((r >> 6) & 63)
        self.top |= 1 << (r >> 12)

    def discard(self, r: int) -> None:
        w = r >> 6
        self.low[w] &= ~(1 << (r & 63))
        if not self.low[w]:
            self.mid[w >> 6] &= ~(1 << (w & 63))
            if not self.mid[w >> 6]:
                self.top &= ~(1 << (w >> 6))

    def first(self) -> int:
        """The lowest rank, or -1."""
        if not self.top:
            return -1
        t = (self.top & -self.top).bit_length() - 1
        m = self.mid[t]
        w = (t << 6) + (m & -m).bit_length() - 1
        b = self.low[w]
        return (w << 6) + (b & -b).bit_length() - 1


class Encoder:
    """Encodes texts without special tokens; their strings in a text are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bits, self.kept = RankBitmap(max(ranks.values(), default=0) + 1), {}

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        n = len(raw)
        part = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # the rank of the pair that starts here, -1 for none or a position that is gone
        buckets: dict[int, list[int]] = {}
        bits = self.bits

        def offer(i: int) -> int:
            j = after[i]
            r = ranks.get(part[i] + part[j], -1) if j < n else -1
            pair[i] = r
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    bits.add(r)
            return r

        for i in range(n - 1):
            offer(i)
        while (r := bits.first()) >= 0:
            bits.discard(r)
            todo = sorted(buckets.pop(r))
            for k, i in enumerate(todo):
                if pair[i] != r:
                    continue
                j = after[i]
                part[i] += part[j]
                nxt = after[j]
                after[i] = nxt
                if nxt < n:
                    before[nxt] = i
                pair[j] = -1
                new = offer(i)
                lowest = new if 0 <= new < r else r
                if before[i] >= 0:
                    new = offer(before[i])
                    lowest = new if 0 <= new < lowest else lowest
                if lowest < r:  # a better pair came up: the rest of this bucket waits
                    rest = todo[k + 1 :] + buckets.get(r, [])
                    if rest:
                        buckets[r] = rest
                        bits.add(r)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def text(self, text: str | None, out: array) -> None:
        """Append the ids of a text to ``out``."""
        if not text:
            return
        kept = self.kept
        for p in self.find(text):
            ids = kept.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8"))
                if len(p) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[p] = ids
            out.extend(ids)

    def decode(self, ids) -> str:
        if not hasattr(self, "_bytes"):
            self._bytes = {v: k for k, v in self.ranks.items()}
        return b"".join(self._bytes[int(i)] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def shared_ranks(spark: SparkSession, path: str):
    """The ranks as a broadcast: a vocabulary file has a fixed size, some hundred kilobytes here."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(df: DataFrame, text: str, ids: str = "ids", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """``df`` without ``text`` and with ``ids``, a list of token ids of each text.

    Null and empty texts have an empty list. Every other column is kept as it is, unless it has the name ``ids``, which the list
    replaces. Nothing is shuffled: each batch of rows is encoded where it is read.
    """
    keep = [c for c in df.columns if c not in (text, ids)]
    ranks = shared_ranks(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(id(ranks.value))
        if enc is None:
            _ENCODERS.clear()  # a worker serves one vocabulary at a time
            enc = _ENCODERS[id(ranks.value)] = Encoder(ranks.value, pattern)
        for batch in batches:
            flat, ends = array("i"), [0]
            for t in batch.column(batch.schema.get_field_index(text)):
                enc.text(t.as_py(), flat)
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), lists], names=[*keep, ids])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{schema}{', ' if keep else ''}`{ids}` array<int>")
