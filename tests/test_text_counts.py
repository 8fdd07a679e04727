import collections
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions import text as T
from tessera.operators import text_counts as C

TEXTS = ["the cat  saw the-cat 12 Cat", "12 3.5 x1 ", "", None, "a b c d e f g h\nb a"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")


def brute(texts):
    for t in texts:
        for line in re.split(r"\r\n|\n|\r", t) if t is not None else ():
            yield line.rstrip(" ").split(" ")


def cls(w):
    return "word" if re.fullmatch(r"[a-z_-]+", w) else "number" if re.fullmatch(r"\d+(\.\d+)?", w) else None


def test_class_counts(spark):
    got = {(r["token_class"], r["token"]): r["n"] for r in C.class_counts(C.lines_of(docs(spark), "text")).collect()}
    want = collections.Counter((cls(w.lower()), w.lower()) for line in brute(TEXTS) for w in line if cls(w.lower()))
    assert got == dict(want)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab 1\n", max_size=40), min_size=1, max_size=6), m=st.integers(1, 6))
def test_pairs_and_stripes(spark, texts, m):
    lines = C.lines_of(docs(spark, texts), "text")
    pairs, stripes = collections.Counter(), collections.Counter()
    for p in brute(texts):
        for i, a in enumerate(p):
            for j, b in enumerate(p):
                if i < j <= i + m and cls(a) and cls(a) == cls(b):
                    pairs[f"{a}:{b}"] += 1
                if i != j and abs(i - j) <= m and cls(a):
                    stripes[(a, b)] += 1
    assert {r["pair"]: r["n"] for r in C.pair_counts(lines, m=m).collect()} == dict(pairs)
    assert {(r["token"], r["nbr"]): r["n"] for r in C.stripe_counts(lines, m=m).collect()} == dict(stripes)
    same = {(r["token"], r["nbr"]): r["n"] for r in C.stripe_counts(lines, m=m, same_class=True).collect()}
    assert all(same[(b, a)] == n for (a, b), n in same.items())


def test_stopwords_and_top(spark):
    counts = C.class_counts(C.lines_of(docs(spark), "text"))
    left = C.top(C.without(counts, C.stopwords(counts, ["the", "the"])), 2, "word").collect()
    assert [tuple(r) for r in left] == [("a", 2), ("b", 2)]
    maps = {r["token"]: r["stripe"] for r in C.as_stripes(C.stripe_counts(C.lines_of(docs(spark), "text"), m=1)).collect()}
    assert maps["b"] == {"a": 2, "c": 1}


def test_lemmas_and_weights(spark):
    got = {r["id"]: r["lemmas"] for r in C.lemmas(docs(spark, ["The cats were running, studies 12 boxes", "", None]), "id", "text", ["the", "be"]).collect()}
    assert got == {0: ["cat", "run", "study", "box"], 1: [], 2: []}
    tf = C.term_frequency(C.lemmas(docs(spark, ["cat dog cat", "dog", "cow cat"]), "id", "text"), "id", "lemmas")
    vocab = C.inverse_frequency(C.vocabulary(tf, 2), 3)
    assert [r["term"] for r in vocab.orderBy("term_id").collect()] == ["cat", "dog"]
    w = {(r["id"], r["term"]): r["weight"] for r in C.weights(tf, "id", vocab).collect()}
    assert abs(w[(0, "cat")] - 2 / 3 * 0.405465) < 1e-5 and (2, "cow") not in w


def test_bits_and_hashtags(spark):
    df = spark.createDataFrame([([1, 0, 1], "#A and #b_c #a"), ([], "none"), (None, None)], "bits array<int>, t string")
    got = df.select(T.bits_to_names(df["bits"], ["x", "y", "z"]).alias("n"), T.hashtags(df["t"]).alias("h")).collect()
    assert [r["n"] for r in got] == [["x", "z"], [], []] and [r["h"] for r in got] == [["#a", "#b_c", "#a"], [], None]
