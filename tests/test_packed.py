from tessera.operators import packed as P

CASES = {
    "drama": ["drama"],
    " Drama / CRIME ,thriller": ["drama", "crime", "thriller"],
    "sci-fi;coming-of-age|anti-war": ["sci-fi", "coming-of-age", "anti-war"],
    "rock & roll + sword and sorcery": ["rock & roll", "sword and sorcery"],
    '"crime, true" / \'war | peace\'': ["crime, true", "war | peace"],
    '""musical/revue"",short': ["musical/revue", "short"],
    "“Stage; Filmed”•Family": ["stage; filmed", "family"],
    "drama\ndrama\tdrama": ["drama", "drama", "drama"],
    ",comedy;;": ["comedy"],
    "director's  cut,action": ["director's cut", "action"],
    "  ": [],
    ";,": [],
    'un"closed,action': ["un", "closed", "action"],
}


def _rows(spark, texts):
    # enough plain values that the marks inside names meet pieces that never stand alone
    more = ["drama", "crime", "action", "comedy", "short", "family", "thriller"] * 10
    return spark.createDataFrame([(k, t, "a", k) for k, t in enumerate([*texts, *more])], "film_id int, genre string, value string, pos int")


def test_pieces_in_order(spark):
    got = {}
    for r in P.split_packed(_rows(spark, CASES), "film_id", "genre").collect():
        got.setdefault(r["film_id"], {})[r["pos"]] = r["value"]
    for k, (text, want) in enumerate(CASES.items()):
        mine = got.get(k, {})
        assert [mine[p] for p in sorted(mine)] == want, text
        assert sorted(mine) == list(range(1, len(want) + 1))


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, "a,b"), (2, "a,b"), (None, "c")], "k int, v string")
    got = {(r["k"], r["pos"], r["value"]) for r in P.split_packed(df, "k", "v").collect()}
    assert got == {(2, 1, "a"), (2, 2, "b"), (None, 1, "c")} and P.split_packed(df, "k", "v").count() == 3
    assert P.split_packed(df.limit(0), "k", "v").count() == 0


def test_marks_are_inferred_for_each_source(spark):
    # In source b the hyphen lies between values that stand alone; in a it does not.
    a = [("a", "sci-fi"), ("a", "drama"), ("a", "drama/sci-fi")] * 20
    b = [("b", "drama-crime"), ("b", "drama"), ("b", "crime"), ("b", "crime-drama")] * 60
    df = spark.createDataFrame([(k, s, v) for k, (s, v) in enumerate(a + b)], "k int, s string, v string")
    told = {(r["source"], r["mark"]): r["accepted"] for r in P.infer_delimiters(df, "v", "s").collect()}
    assert told[("a", "-")] is False and told[("a", "/")] is True and told[("b", "-")] is True
    got = {r["value"] for r in P.split_packed(df, "k", "v", "s").collect()}
    assert got == {"sci-fi", "drama", "crime"}


def test_very_long_field(spark):
    df = spark.createDataFrame([(1, ",".join(["x y"] * 50_000))], "k int, v string")
    assert P.split_packed(df, "k", "v").count() == 50_000


def test_a_comma_is_no_delimiter_where_its_pieces_never_stand_alone(spark):
    names = [("a", f"{x}, {y}") for x in ("Ann", "Ben", "Cy", "Di", "Ed") for y in ("Doe", "Roe", "Poe", "Moe", "Noe", "Foe", "Zoe", "Loe")]
    values = [("b", x) for x in ("drama", "crime", "drama, crime", "crime,drama")] * 10 + [(None, "x, y"), (None, "x")]
    df = spark.createDataFrame([(k, s, v) for k, (s, v) in enumerate(names + values)], "k int, s string, v string")
    told = {(r["source"], r["mark"]): r["accepted"] for r in P.infer_delimiters(df, "v", "s").collect()}
    assert told == {("a", ","): False, ("b", ","): True, ("", ","): True}
    got = {}
    for r in P.split_packed(df, "k", "v", "s").orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append(r["value"])
    assert got == {k: [v.lower()] if s == "a" else [x.strip() for x in v.split(",")] for k, (s, v) in enumerate(names + values)}


def test_a_key_in_two_sources_comes_out_once(spark):
    df = spark.createDataFrame([(1, "a", "x,y"), (1, "b", "x,y"), (1, None, "x,y")], "k int, s string, v string")
    assert sorted(tuple(r) for r in P.split_packed(df, "k", "v", "s").collect()) == [(1, 1, "x"), (1, 2, "y")]
