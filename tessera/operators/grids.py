"""Scores of a grid of classification trees or forests over folds: the points that share a binning are read off the same trees.

A tree of depth 5 is the top of the tree of depth 15 on the same rows and bins, and a forest of 5 trees the first 5 of one of 20, as the
rows and features of a tree are drawn by its number, level by level. So a task grows the trees of one fold, impurity and number of bins
and scores each depth and number of trees on the rows of the fold. Bins, splits, leaves and the pruning of like leaves follow Spark's
trees, with two differences: bins come from all rows of the folds fitted on, not from a sample, and the area under the curve from all
scores, not from 1,000 of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODES = 150_000_000  # values, rows times features, up to which each task has all rows
VALUES = 200_000  # different values of all features, with one count for each fold, that the driver takes


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Where Spark's trees cut a feature of sorted ``values``: between all of them if they are few, else where about as many rows lie between two."""
    held = counts > 0
    values, counts = values[held], counts[held]
    between = (values[:-1] + values[1:]) / 2
    bins = min(bins, int(counts.sum()))
    if len(between) < bins:
        return between
    stride = counts.sum() / bins
    out, so_far, goal = [], int(counts[0]), stride
    for k, c in enumerate(counts[1:].tolist()):
        if abs(so_far - goal) < abs(so_far + c - goal):
            out.append(k)
            goal += stride
        so_far += c
    return between[out]


def _cells(key: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, sum of ``w`` of each)."""
    if size <= len(key):
        total = np.bincount(key, w, size)
        k = np.flatnonzero(total)
        return k, total[k].astype(np.int64)
    bits = int(w.max(initial=0)).bit_length()
    s = np.sort(key << bits | w)
    k = s >> bits
    start = np.flatnonzero(np.diff(k, prepend=-1))
    return k[start], np.add.reduceat(s & ((1 << bits) - 1), start) if len(s) else s


def _first_best(gain: np.ndarray) -> np.ndarray:
    """The first place in each row whose gain is the greatest but for rounding."""
    most = gain.max(1, keepdims=True)
    return (gain >= most - 1e-10 * np.abs(most)).argmax(1)


class Tree:
    """Nodes level by level: counts by class, left and right child or -1, level; ``at``: for each depth the node of each row of ``test``."""

    def __init__(self, bins: np.ndarray, widths: Sequence[int], y: np.ndarray, w: np.ndarray, classes: int, depths: Sequence[int], impurity: str, test: np.ndarray, drawn: int = 0, rng: np.random.Generator | None = None) -> None:
        """bins, test: a row for each feature; widths: bins of each feature; w: how often a row counts; drawn: features that a node may split on, 0 for all."""
        single = np.array([f for f, x in enumerate(widths) if x == 2], int)
        many = [f for f, x in enumerate(widths) if x > 2]
        entropy = impurity == "entropy"
        k = np.arange(int(w.sum()) + 1, dtype=float)
        g = k * np.log2(np.maximum(k, 1)) if entropy else k * k

        def gain(left, right, nl, nr, whole, n):
            """By how much the split lowers the impurity, times the rows; left, right, whole: sums of g over classes."""
            if entropy:
                return np.where((nl > 0) & (nr > 0), left + right - g[nl] - g[nr] - (whole - g[n]), -np.inf)
            return np.where((nl > 0) & (nr > 0), left / np.maximum(nl, 1) + right / np.maximum(nr, 1) - whole / n, -np.inf)

        rows = np.flatnonzero(w)
        y, w = y[rows].astype(np.int64), w[rows].astype(np.int64)
        flat = bins.reshape(-1)
        each = [np.flatnonzero(bins[f].take(rows)) for f in single]  # one-hot features as the few that a row has
        pairs, of = np.concatenate([*each, np.zeros(0, np.int64)]), np.repeat(np.arange(len(single), dtype=np.int32), [len(x) for x in each])
        del each
        node = np.zeros(len(rows), np.int64)
        here, first = np.bincount(y, w, classes)[None].astype(np.int64), 0
        at, counts, left, right, level, self.at = np.zeros(test.shape[1], np.int64), [here], [], [], [], {}
        for deep in range(max(depths) + 1):
            if deep in depths:
                self.at[deep] = at.copy()
            child = np.full((2, len(here)), -1)
            left.append(child[0])
            right.append(child[1])
            level.append(np.full(len(here), deep))
            open_ = np.flatnonzero((here > 0).sum(1) > 1)
            m = len(open_)
            if deep == max(depths) or not m:
                break
            place = np.full(len(here), -1)  # -1: a leaf
            place[open_] = np.arange(m)
            node = place[node]
            rows, y, w, node, pairs, of = _kept(node >= 0, rows, y, w, node, pairs, of)
            total = here[open_]
            n, whole = total.sum(1), g[total].sum(1)
            told, cut = np.full((m, len(widths)), -np.inf), np.zeros((m, len(widths)), np.int64)
            of_class = node * classes + y
            may = None
            if drawn and drawn < len(widths):
                may = np.zeros((m, len(widths)), bool)
                np.put_along_axis(may, rng.random((m, len(widths))).argpartition(drawn - 1, 1)[:, :drawn], True, 1)
            if len(single):
                size = len(single)
                p, f = pairs, of
                if may is not None:
                    some = np.flatnonzero(may[:, single].reshape(-1).take(node.take(p) * size + f))
                    p, f = p.take(some), f.take(some)
                key, c = _cells(of_class.take(p) * size + f, w.take(p), m * classes * size)
                group = key // size
                slot, t = group // classes * size + key % size, total.reshape(-1)[group]
                r, l, nr = (np.bincount(slot, x, m * size).reshape(m, size) for x in (g[c], g[t - c] - g[t], c))
                nr = nr.astype(np.int64)
                x = gain(whole[:, None] + l, r, n[:, None] - nr, nr, whole[:, None], n[:, None])
                told[:, single] = x if may is None else np.where(may[:, single], x, -np.inf)
            for f in many:
                b, nodes, own, r, v = widths[f], np.arange(m), of_class, rows, w
                if may is not None:
                    nodes = np.flatnonzero(may[:, f])
                    if not len(nodes):
                        continue
                    renamed = np.zeros((m, classes), np.int64)
                    renamed[nodes] = np.arange(len(nodes) * classes).reshape(-1, classes)
                    some = np.flatnonzero(may[:, f].take(node))
                    own, r, v = renamed.reshape(-1).take(of_class.take(some)), rows.take(some), w.take(some)
                key, c = _cells(own * b + bins[f].take(r), v, len(nodes) * classes * b)
                group = key // b
                after = np.cumsum(c)
                start = np.flatnonzero(np.diff(group, prepend=-1))
                after -= np.repeat((after - c)[start], np.diff(start, append=len(key)))
                before, t = after - c, total[nodes].reshape(-1)[group]
                slot = group // classes * b + key % b
                l, r, nl = (np.bincount(slot, x, len(nodes) * b).reshape(-1, b).cumsum(1)[:, :-1] for x in (g[after] - g[before], g[t - after] - g[t - before], c))
                nl = nl.astype(np.int64)
                x = gain(l, whole[nodes, None] + r, nl, n[nodes, None] - nl, whole[nodes, None], n[nodes, None])
                best = _first_best(x)
                told[nodes, f], cut[nodes, f] = x[np.arange(len(nodes)), best], best
            best = _first_best(told)
            split = np.flatnonzero(told[np.arange(m), best] > 1e-12 * (1 + g[n]))
            if not len(split):
                break
            by, over = best[split], cut[split, best[split]]
            nth = np.full(m, -1)
            nth[split] = np.arange(len(split))
            node = nth[node]
            rows, y, w, node, pairs, of = _kept(node >= 0, rows, y, w, node, pairs, of)
            node = 2 * node + (flat.take(by.take(node) * bins.shape[1] + rows) > over.take(node))
            after = first + len(here)
            child[:, open_[split]] = after + 2 * np.arange(len(split)) + np.array([[0], [1]])
            there = np.flatnonzero(at >= first)
            j = place[at[there] - first]
            j = np.where(j >= 0, nth[j], -1)
            there, j = there[j >= 0], j[j >= 0]
            at[there] = after + 2 * j + (test[by[j], there] > over[j])
            here, first = np.bincount(node * classes + y, w, 2 * len(split) * classes).astype(np.int64).reshape(-1, classes), after
            counts.append(here)
        self.at |= {d: at for d in depths if d not in self.at}
        self.counts, self.left, self.right, self.level = (np.concatenate(x) for x in (counts, left, right, level))

    def predicted(self, depth: int) -> np.ndarray:
        """The class of each row of ``test`` in the tree of this depth; of like ones, the first."""
        return self.counts.argmax(1)[self.at[depth]]

    def shares(self, depth: int) -> np.ndarray:
        """The shares of the classes in the leaf of each row of ``test``, where leaves beside each other that predict the same are one."""
        like, leaf, own = self.counts.argmax(1), (self.left < 0) | (self.level == depth), np.arange(len(self.left))
        inner = [np.flatnonzero((self.level == k) & (self.left >= 0)) for k in range(depth)]
        for ids in reversed(inner):
            l, r = self.left[ids], self.right[ids]
            one = leaf[l] & leaf[r] & (like[l] == like[r])
            leaf[ids[one]], like[ids[one]] = True, like[l[one]]
        for ids in inner:
            closed = leaf[ids] | (own[ids] != ids)
            for child in (self.left[ids], self.right[ids]):
                own[child] = np.where(closed, own[ids], child)
        c = self.counts[own[self.at[depth]]]
        return c / c.sum(1, keepdims=True)


def _kept(keep: np.ndarray, rows, y, w, node, pairs, of):
    """All of these for the rows that are kept; ``pairs`` are places of rows."""
    if keep.all():
        return rows, y, w, node, pairs, of
    new, k, p = np.cumsum(keep) - 1, np.flatnonzero(keep), np.flatnonzero(keep.take(pairs))
    return rows.take(k), y.take(k), w.take(k), node.take(k), new.take(pairs.take(p)), of.take(p)


def area(score: np.ndarray, yes: np.ndarray) -> float:
    """The area under the curve; 0 without rows of both kinds, as Spark has it."""
    values, at = np.unique(score, return_inverse=True)
    p, q = np.bincount(at, yes, len(values)), np.bincount(at, ~yes, len(values))
    return float((p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum())) if p.sum() and q.sum() else 0.0


def _fitted(codes: Callable[[int], np.ndarray], y: np.ndarray, fold: np.ndarray, k: int, values: list, counts: list, classes: int, impurity: str, bins: int, depths: Sequence[int], trees: Sequence[int], seed: int) -> Iterator[tuple[int, int, float]]:
    """(depth, trees, score) on fold ``k`` of what the other folds give; trees of () is a single tree with accuracy as its score.

    codes: of a feature, the place of each row's value among its values."""
    train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
    cuts = [thresholds(v, c.sum(0) - c[k], bins) for v, c in zip(values, counts)]
    kind, n_features = np.uint8 if max(map(len, cuts), default=0) < 256 else np.int32, len(cuts)
    mine, theirs = (np.empty((n_features, len(x)), kind) for x in (train, test))
    for f, (v, cut) in enumerate(zip(values, cuts)):
        bin_of, code = np.searchsorted(cut, v, "left").astype(kind), codes(f)
        mine[f], theirs[f] = bin_of.take(code[train]), bin_of.take(code[test])
    widths, own, held = [len(x) + 1 for x in cuts], y[train], y[test]
    del train, test, fold
    if not trees:
        one = Tree(mine, widths, own, np.ones(len(own), np.int64), classes, depths, impurity, theirs)
        for d in depths:
            yield d, 0, float((one.predicted(d) == held).mean()) if len(held) else float("nan")
        return
    drawn = int(np.ceil(np.sqrt(n_features)))
    scores = {d: np.zeros(len(held)) for d in depths}
    for t in range(max(trees)):
        rng = np.random.default_rng([seed, t])
        one = Tree(mine, widths, own, rng.poisson(1.0, len(own)), classes, depths, impurity, theirs, drawn, rng)
        for d in depths:
            scores[d] += one.shares(d)[:, 1]
            if t + 1 in trees:
                yield d, t + 1, area(scores[d], held == 1)


def _values(df: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], int, int, int] | None:
    """(sorted values, counts by value, classes, rows, folds) of (fold, label, features); None for more than VALUES of them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fold, x = b["fold"].to_numpy(), b["x"].flatten().to_numpy().reshape(b.num_rows, -1)
            for f in range(x.shape[1]):
                v, at = np.unique(x[:, f] + 0.0, return_inverse=True)
                key, n = np.unique(at.reshape(-1) * 1000 + fold, return_counts=True)
                yield pa.record_batch({"f": pa.array(np.full(len(n), f, np.int32)), "v": v[key // 1000], "fold": pa.array((key % 1000).astype(np.int32)), "n": n})

    each = df.select("fold", "x").mapInArrow(found, "f int, v double, fold int, n bigint").groupBy("f", "v", "fold").agg(F.sum("n").alias("n"))
    told = each.limit(VALUES + 1).toArrow()
    if told.num_rows > VALUES or not told.num_rows:
        return None
    f, v, fold, n = (told[c].to_numpy() for c in ("f", "v", "fold", "n"))
    values, counts = [], []
    for k in range(int(f.max()) + 1):
        u, at = np.unique(v[f == k], return_inverse=True)
        c = np.zeros((int(fold.max()) + 1, len(u)), np.int64)
        c[fold[f == k], at] = n[f == k]
        values.append(u)
        counts.append(c)
    rows = int(counts[0].sum())
    return values, counts, max(2, int(df.agg(F.max("y")).first()[0]) + 1), rows, len(counts[0])


def grid_scores(df: DataFrame, grid: dict[str, Sequence], seed: int = 0) -> list[tuple[dict, float]] | None:
    """(parameters, mean score over the folds) of each point of ``grid``, in its order.

    ``df`` has (h, fold, y, x): a number that tells rows apart, the fold from 0, the label from 0 and the features as an array. The grid
    has maxDepth, impurity, maxBins and, for forests, numTrees of at least 2. A single tree is scored by accuracy, a forest of two
    classes by the area under the curve. None if the rows are more than CODES and VALUES allow.
    """
    spark = df.sparkSession
    known = _values(df)
    if known is None or known[3] * len(known[0]) > CODES:
        return None
    values, counts, classes, _, folds = known
    kinds = [None if len(v) <= 2 else np.uint8 if len(v) <= 256 else np.int32 for v in values]  # None: a bit
    sign = np.uint8 if classes <= 256 else np.int32

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b["x"].flatten().to_numpy().reshape(b.num_rows, -1)
            codes = (np.searchsorted(v, x[:, f]) for f, v in enumerate(values))
            each = [np.packbits(c.astype(bool)) if kind is None else c.astype(kind) for c, kind in zip(codes, kinds)]
            each += [b["h"].to_numpy().astype(np.int64), b["fold"].to_numpy().astype(np.uint16), b["y"].to_numpy().astype(sign)]
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int32()), "data": pa.array([b"".join(c.tobytes() for c in each)], pa.binary())})

    def column(blocks: list, j: int) -> np.ndarray:
        """Of all blocks, what stands at place ``j``: the codes of a feature, then h, fold and label."""
        out = []
        for n, data in blocks:
            low = 0
            for kind in (all_kinds := [*kinds, np.int64, np.uint16, sign])[:j]:
                low += (n + 7) // 8 if kind is None else n * np.dtype(kind).itemsize
            kind = all_kinds[j]
            out.append(np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, low), count=n) if kind is None else np.frombuffer(data, kind, n, low))
        return np.concatenate(out)

    depths, trees = sorted(grid["maxDepth"]), sorted(grid.get("numTrees", ()))
    # The most bins first, so that none of them is left to run alone.
    parts = [(k, i, b) for b in sorted(grid["maxBins"], reverse=True) for i in grid["impurity"] for k in range(folds)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, data, blocks = None, None, []
        for batch in batches:
            for part, n, data in zip(batch["part"].to_pylist(), batch["n"].to_pylist(), batch["data"]):
                which = part
                blocks.append((n, data.as_py()))
            del batch, data
        if which is None:
            return
        order = np.argsort(column(blocks, len(kinds)), kind="stable")
        fold, y = (column(blocks, len(kinds) + j)[order] for j in (1, 2))
        k, impurity, bins = parts[which]
        out = list(_fitted(lambda f: column(blocks, f)[order], y, fold, k, values, counts, classes, impurity, bins, depths, trees, seed))
        yield pa.record_batch({"part": pa.array([which] * len(out), pa.int64()), "depth": pa.array([x[0] for x in out], pa.int32()), "trees": pa.array([x[1] for x in out], pa.int32()), "score": pa.array([x[2] for x in out], pa.float64())})

    blocks = df.mapInArrow(packed, "n int, data binary").repartition(1).persist()
    try:
        each = spark.range(0, len(parts), 1, len(parts)).withColumnRenamed("id", "part")
        told = each.crossJoin(blocks.hint("shuffle_replicate_nl")).mapInArrow(scored, "part bigint, depth int, trees int, score double").collect()
    finally:
        blocks.unpersist()
    score = {(*parts[r["part"]], r["depth"], r["trees"]): r["score"] for r in told}
    points = [dict(zip(grid, x)) for x in product(*grid.values())]
    return [(p, float(np.mean([score[k, p["impurity"], p["maxBins"], p["maxDepth"], p.get("numTrees", 0)] for k in range(folds)]))) for p in points]


def rows_of(prepared: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """(h, fold, y, x) of (key, label, features): the fold by a hash of the key, the same whatever the partitions."""
    of = lambda n: F.xxhash64(F.col(key), F.lit(seed), F.lit(n))
    return prepared.select(of("order").alias("h"), F.pmod(of("fold"), F.lit(folds)).cast("int").alias("fold"), F.col("label").cast("int").alias("y"), vector_to_array("features").alias("x"))
