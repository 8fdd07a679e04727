import collections
import itertools
import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import cooccur as C
from tessera.operators import sets


def brute(rows, support, lift, llr=0.0):
    held = collections.defaultdict(set)
    for u, i in rows:
        if u is not None and i is not None:
            held[u].add(i)
    n, one, two = len(held), collections.Counter(), collections.Counter()
    for items in held.values():
        one.update(items)
        two.update(itertools.combinations(sorted(items), 2))
    x = lambda v: v * math.log(v) if v else 0.0
    out = {}
    for (a, b), c in two.items():
        g = 2 * (x(c) + x(one[a] - c) + x(one[b] - c) + x(n - one[a] - one[b] + c) - x(one[a]) - x(n - one[a]) - x(one[b]) - x(n - one[b]) + x(n))
        if c >= support and c * n >= lift * one[a] * one[b] and max(0, g) >= llr:
            out[(a, b)] = (c, one[a], one[b])
    return out


def run(spark, rows, support, lift, llr=0.0):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "u int, i int, n int, seg string")
    return {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"]) for r in C.item_pairs(df, "u", "i", support, lift, llr).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 12)), st.one_of(st.none(), st.integers(-9000, 9000).filter(lambda x: x % 1500 == 0))), max_size=120), support=st.integers(1, 3), lift=st.sampled_from([0.0, 1.0, 2.5]))
def test_against_brute_force(spark, rows, support, lift):
    assert run(spark, rows, support, lift) == brute(rows, support, lift)


def test_large_baskets_and_hot_items(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 8)
    rng = np.random.default_rng(0)
    rows = [(0, i) for i in range(60)] + [(1, i) for i in range(20, 70)]
    rows += [(u, int(i)) for u in range(2, 40) for i in rng.choice(70, 5)] + [(u, 999) for u in range(40)]
    assert run(spark, rows, 2, 1.2) == brute(rows, 2, 1.2)
    assert run(spark, rows, 2, 1.0, 3.0) == brute(rows, 2, 1.0, 3.0)


def test_folding_in_parts(monkeypatch):
    monkeypatch.setattr(C, "HELD", 10)
    parts = [C._key(np.array([1, 5, 2] * 4), np.array([2, 1, 9] * 4)) for _ in range(5)]
    got = collections.Counter()
    for b in C._folded(iter(parts)):
        for r in b.to_pylist():
            for x, n in zip(r["nbrs"], r["cnts"]):
                got[(r["a"], x)] += n
    assert got == {(1, 2): 20, (1, 5): 20, (2, 9): 20}


def test_alias(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "u int, i int")
    alias = spark.createDataFrame([(5, 7), (5, 8), (None, 1), (7, 100)], "bad int, good int")
    assert sorted((r["u"], r["i"] or 0) for r in sets.looked_up(df, "i", alias, "bad", "good").collect()) == [(1, 6), (1, 7), (2, 0)]


def test_stripes_of_a_key_are_merged_over_batches():
    keys = C._key(np.array([1, 1, 2, 1, 2]), np.array([5, 9000, 7, 5, 7]))
    batches = [C._stripes(*C._counted(keys[p], np.ones(len(p), dtype=np.int64))) for p in ([0], [0, 3], [1], [2], [4])]
    got = [tuple(r.values()) for b in C.merged(iter(batches), 2) for r in b.to_pylist()]
    assert got == [(1, 5, 3), (2, 7, 2)]
