import collections
import math
import re
import unicodedata

from tessera.llm import distinctive as D
from tessera.llm import lookalike as L

PLOTS = {1: "The cat the cat THE dog " * 4, 2: "a dog and a dog", 3: "", 4: None, 5: "Ñandú ñandú don't", 6: "12 34 !"}


def test_tf_idf_against_brute_force(spark):
    rows = [(k, v, 1, "x") for k, v in PLOTS.items()]
    df = spark.createDataFrame([*rows, rows[0], (None, "lost words", 1, "x")], "id int, plot string, tf int, term string")
    words = {k: [w.lower() for w in re.findall(r"[^\W\d_]+", v)] for k, v in PLOTS.items() if v is not None}
    spread = collections.Counter(w for ws in words.values() for w in set(ws))
    want = {(k, w): round(n / len(ws) * (math.log((1 + len(words)) / (1 + spread[w])) + 1), 9) for k, ws in words.items() for w, n in collections.Counter(ws).items()}
    for hot, few in ((1, 0), (1000, 0), (1, 1000)):
        got = {(r["id"], r["term"]): round(r["score"], 9) for r in D.tf_idf(df, "id", "plot", hot, few).collect()}
        assert got == want
    assert {r["id"]: r["term"] for r in D.most_distinctive(df, "id", "plot").collect()} == {1: "the"}
    assert D.tf_idf(df.limit(0), "id", "plot").count() == 0


def test_ties_go_to_the_rarer_then_first_term(spark):
    df = spark.createDataFrame([(1, "b a b a c"), (2, "c d")], "id int, plot string")
    assert {r["id"]: r["term"] for r in D.most_distinctive(df, "id", "plot", 1).collect()} == {1: "a", 2: "d"}


SAME = [
    ["Café 52", "Café 52", "Ｃａｆé　５２", "Cаfé 52", "Ca​fé 5­2"],
    ["ộ́ x", "ộ́ x", "ộ́ x"],
    ["Όλοι ακούν", "Όλοι ακούν"],
    ["がぎ", "がぎ"],
    ["ガ", "ｶﾞ"],
    ["a\r\nb", "a\nb"],
    ["Vary IV", "\U0001d415\U0001d41a\U0001d42b\U0001d432 \u2160V", "Ꮩary IV", "Vαrу IV"],
]
OTHER = ["Cafe 52", "café 52", "Café 53", "Café, 52", "Cafè 52", "Café  52", "a\tb", "a b", "\U0001f469‍\U0001f680", "\U0001f469\U0001f680", "ﬁ", "fi", "1", "l", "ス", "す"]


def test_classes_and_forms(spark):
    texts = [t for g in SAME for t in g] + OTHER
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(900, None, "x", 1), (901, " ​ ", "x", 1), (902, "  ", "x", 1), (None, "Café 52", "x", 1), (903, texts[0], "x", 1)]
    df = spark.createDataFrame(rows, "id int, t string, form string, class_id int")
    want, at = set(), 0
    for g in SAME:
        ids = list(range(at, at + len(g)))
        at += len(g)
        want |= {(a, b) for a in ids for b in ids if a < b}
    want |= {(b, 903) for b in range(1, len(SAME[0]))}
    got = [(r["doc_a"], r["doc_b"]) for r in L.lookalike_pairs(df, "id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    forms = {r["id"]: (r["class_id"], r["form"]) for r in L.consistent_form(df, "id", "t").collect() if r["id"] is not None}
    assert forms[4] == (0, texts[0]) and forms[903] == (0, texts[0]) and forms[900] == (None, None) and forms[902][1] == "  "
    told = collections.defaultdict(set)
    for k, (_, f) in forms.items():
        told[f].add(k)
    assert all(len(told[texts[k]]) == 1 for k in range(at, len(texts)))


def test_many_copies_link_every_text(spark):
    rows = [(k, "naïve") for k in range(60)] + [(100 + k, "naïve") for k in range(60)] + [(500, "ｎaïve")]
    df = spark.createDataFrame(rows, "id int, t string")
    assert L.lookalike_pairs(df, "id", "t").count() == 60 * 60 + 120
    few = {(r["doc_a"], r["doc_b"]) for r in L.lookalike_pairs(df, "id", "t", full=10).collect()}
    # A class beyond the bound: every row is linked to the head, and the head's copies to the next text.
    assert few == {(k, 100) for k in range(60)} | {(0, 100 + k) for k in range(60)} | {(0, 500)}
    assert {r["class_id"] for r in L.consistent_form(df, "id", "t").collect()} == {0}
    assert L.lookalike_pairs(df.limit(0), "id", "t").count() == 0


def test_table_maps_to_settled_characters():
    a, b = L._table()
    assert len(a) == len(set(a)) == len(b) and not set(b) & set(a)
    assert all(unicodedata.normalize("NFC", c) == c for c in b)
