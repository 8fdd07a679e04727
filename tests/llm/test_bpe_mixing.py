import collections
from array import array
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe as B
from tessera.llm import mixing as M

PATH = f"{B.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def enc():
    return B.Encoder(B.read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{B.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def ids(enc, text):
    out = array("i")
    enc.text(text, out)
    return out.tolist()


@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text(alphabet="aab <|endoftext|>'s\n\t 09é日🔥", max_size=120)))
def test_same_as_the_library(enc, library, text):
    text = text.encode("utf-8", "ignore").decode()
    got = ids(enc, text)
    assert got == library.encode(text, add_special_tokens=False).ids and enc.decode(got) == text


def test_long_pieces(enc, library):
    text = "ab" * 30_000 + "a" * 30_000 + " " * 5_000
    assert ids(enc, text) == library.encode(text, add_special_tokens=False).ids


def test_bitmap():
    b, rng = B.RankBitmap(50_257), np.random.default_rng(0)
    have = set()
    for r in rng.integers(0, 50_257, 3000).tolist():
        (b.add if r % 3 else b.discard)(r)
        (have.add if r % 3 else have.discard)(r)
        assert b.first() == (min(have) if have else -1)


def test_merges_wait_for_better_pairs():
    # "bc" ranks before "ab", and "abb" is better than both once it can be made.
    ranks = {bytes([c]): 100 + c for c in b"abc"} | {b"ab": 5, b"bc": 6, b"abab": 1}
    e = B.Encoder(ranks)
    assert e.piece(b"ababab") == [1, 5] and e.piece(b"abc") == [5, 100 + ord("c")]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", None)], "doc_id int, text string, ids string")
    assert {r["doc_id"]: r["ids"] for r in B.encode(df, "text").collect()} == {1: [], 2: [], 3: [31373, 995]}
    assert B.encode(df.limit(0), "text").count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        p = M.permuted(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
    assert (M.permuted(np.arange(1000), 1000, 5) != M.permuted(np.arange(1000), 1000, 6)).any()


def corpus(spark):
    rows = [(k, f"big text number {k} " * (1 + k % 5), "big", 1) for k in range(300)]
    rows += [(1000 + k, f"a small one {k}", "small", 1) for k in range(20)]
    rows += [(2000 + k, "the very same words", "copies", 1) for k in range(400)]
    rows += [(3000, None, "big", 1), (3001, "", "small", 1), (3002, "no source", None, 1), (3003, "no target", "other", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 2), ("copies", 0.05, 5), ("nothing", 0.05, 3)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_blocks_hold_all_tokens(spark):
    docs, _ = corpus(spark)
    t = B.encode(docs.where("length(text) > 0 and source is not null").select("doc_id", "source", "text"), "text")
    want = collections.Counter((r["source"], i) for r in t.collect() for i in r["ids"])
    blocks = M.packed_blocks(t, 16).collect()
    assert collections.Counter((r["source"], i) for r in blocks for i in r["ids"]) == want
    by = collections.defaultdict(dict)
    for r in blocks:
        by[r["source"]][r["block"]] = r["n_tokens"]
    for sizes in by.values():
        assert sorted(sizes) == list(range(len(sizes))) and all(sizes[k] == 16 for k in range(len(sizes) - 1))


def test_mix_keeps_shares_and_repeats(spark):
    docs, targets = corpus(spark)
    rules = M.MixRules(block_tokens=8, shard_blocks=16)
    m = M.Mix(docs, targets, rules=rules)
    rows = m.rows().collect()
    uses = collections.Counter((r["source"], r["block"]) for r in rows)
    most = {"big": 1, "small": 2, "copies": 5}
    assert all(n <= most[s] for (s, _), n in uses.items())
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    told = {r["source"]: r for r in m.shares().collect()}
    mixed = collections.Counter()
    for r in rows:
        mixed[r["source"]] += len(r["ids"])
    assert {s: r["mixed_tokens"] for s, r in told.items()} == {s: mixed.get(s, 0) for s in told}
    assert told["copies"]["size_tokens"] == 4 and told["nothing"]["mixed_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in told.values()) - 1) < 1e-9
    assert [tuple(r) for r in sorted(m.rows().collect())] == [tuple(r) for r in sorted(rows)]
    wanted = M.Mix(docs, targets, rules=M.MixRules(block_tokens=8, shard_blocks=16, total_tokens=800))
    for s, share in (("big", 0.6), ("small", 0.3)):
        got = {r["source"]: r["actual_share"] for r in wanted.shares().collect()}[s]
        assert abs(got - share / 0.95) < 0.12


def test_mix_of_nothing(spark):
    docs, targets = corpus(spark)
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        m = M.Mix(d, t)
        assert m.rows().count() == 0 and m.shares().count() == t.count()
    with pytest.raises(ValueError):
        M.Mix(docs, targets.unionAll(targets))


def test_short_sources_stop_at_their_repeats_and_are_reported(spark):
    docs, targets = corpus(spark)
    m = M.Mix(docs, targets, rules=M.MixRules(block_tokens=8, shard_blocks=16))
    told = {r["source"]: r for r in m.shares().collect()}
    size = sum(r["size_tokens"] for r in told.values())
    for s, r in told.items():
        lacks = max(0, int(r["target_share"] / 0.95 * size) - r["size_tokens"] * r["max_repeats"]) if r["size_tokens"] else 0
        assert abs(r["short_tokens"] - lacks) <= 1 and r["most_uses"] <= r["max_repeats"]
    assert told["copies"]["short_tokens"] > 0 and told["small"]["short_tokens"] > 0 and told["big"]["short_tokens"] == 0
    # What a short source has lies in early and late shards alike.
    shards = [r["shard"] for r in m.rows().collect() if r["source"] == "small"]
    last = -(-m.slots // 16) - 1
    assert min(shards) < last / 4 and max(shards) > last * 3 / 4


def test_parts_of_a_source_do_not_change_its_tokens(spark):
    docs, _ = corpus(spark)
    t = B.encode(docs.where("length(text) > 0 and source is not null").select("doc_id", "source", "text"), "text")
    few, many = (collections.Counter((r["source"], i) for r in M.packed_blocks(t, 16, n).collect() for i in r["ids"]) for n in (50_000, 7))
    assert few == many
