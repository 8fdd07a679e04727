import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import records as R

GOOD = '1990,"A, B",x,y,"c ""d"" \\"e\\"",drama,w,"the\nplot"'
CASES = [
    (GOOD, None),
    ("1990,22,,,,,,something happens", None),
    ('1990,"a"b,x,y,c,g,w,p', "quoting"),
    ('1990,a "q" b,x,y,c,g,w,p', "quoting"),
    ('1990,"open,x,y,c,g,w,p', "quoting"),
    ('1990,t,x,y,c,g,w,"ends with \\"', "quoting"),
    ('1990, "t",x,y,c,g,w,p', "quoting"),
    ("1990,t,x,y,c,g,w", "columns"),
    ("1990,t,x,y,c,g,w,p,q", "columns"),
    ("", "columns"),
    (None, "columns"),
    ("c. 1990,t,x,y,c,g,w,p1", "value"),
    ("1879,t,x,y,c,g,w,p1", "value"),
    ("2031,t,x,y,c,g,w,p1", "value"),
    ("1990, ,x,y,c,g,w,p1", "value"),
    ("1990,t,x,y,c,g,w,", "value"),
    ("1990,N/A,x,y,c,g,w,p1", "value"),
    ("1990,t,x,y,c,g,w,[NULL]", "value"),
    ("1990,t,x,y,c,g,w,--", "value"),
    ("1990,t�,x,y,c,g,w,p1", "value"),
    ("1990,t,x,y,c,g,w,a\x07b", "value"),
]


def test_reasons_and_values(spark):
    df = spark.createDataFrame([(k, line, "x", 1) for k, (line, _) in enumerate(CASES)], "line_id int, raw_line string, reason string, title int")
    bad = {r["line_id"]: r["reason"] for r in R.failed_records(df, "line_id", "raw_line").collect()}
    assert bad == {k: r for k, (_, r) in enumerate(CASES) if r}
    good = {r["line_id"]: r for r in R.strict_load(df, "line_id", "raw_line").collect()}
    assert set(good) == {k for k, (_, r) in enumerate(CASES) if not r}
    assert good[0]["title"] == "A, B" and good[0]["cast_list"] == 'c "d" "e"' and good[0]["plot"] == "the\nplot"


def test_empty_table_and_long_records(spark):
    empty = spark.createDataFrame([], "line_id int, raw_line string")
    assert R.failed_records(empty, "line_id", "raw_line").count() == 0
    long = '1990,"' + 'a""b\\"' * 100_000 + '",o,d,c,g,w,"plot text"'
    df = spark.createDataFrame([(1, long), (2, '"' * 100_001)], "line_id int, raw_line string")
    assert [tuple(r) for r in R.failed_records(df, "line_id", "raw_line").collect()] == [(2, "quoting")]


def test_valid_and_failed_are_all(spark):
    df = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(CASES)], "line_id int, raw_line string")
    ids = lambda x: {r[0] for r in x.select("line_id").collect()}
    good, bad = ids(R.strict_load(df, "line_id", "raw_line")), ids(R.failed_records(df, "line_id", "raw_line"))
    assert not good & bad and good | bad == set(range(len(CASES)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.lists(st.text(alphabet='ab",\n é', max_size=6), min_size=8, max_size=8), min_size=1, max_size=20))
def test_round_trip_of_written_csv(spark, rows):
    lines = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string")
    got = df.where(R.has_columns(F.col("x"), 8)).select("k", R.fields(F.col("x")).alias("f")).collect()
    assert {r["k"]: r["f"] for r in got} == dict(enumerate(rows))


@pytest.mark.parametrize("n", [1, 3])
def test_other_shapes(spark, n):
    rules = R.RecordRules(columns=[f"c{k}" for k in range(n)], year=None, required=())
    df = spark.createDataFrame([(1, ",".join("x" * n)), (2, "a,b")], "i int, v string")
    assert {r["i"] for r in R.strict_load(df, "i", "v", rules).collect()} == {1}


def test_films_named_like_a_placeholder_load(spark):
    lines = {1: "Unknown", 2: "None", 3: "Missing", 4: "Untitled", 5: "(missing)", 6: "[Unknown]", 7: "NaN", 8: "#REF!", 9: "n/a"}
    rows = [(k, f"1990,{t},o,d,c,g,w,plot text") for k, t in lines.items()] + [(20 + k, f"1990,t,o,d,c,g,w,{t}") for k, t in lines.items()]
    df = spark.createDataFrame([*rows, (None, "1990,t,o,d,c,g,w"), (None, 'x"')], "i int, v string")
    got = [tuple(r) for r in R.failed_records(df, "i", "v").collect()]
    assert sorted(got, key=str) == sorted([(k, "value") for k in (5, 6, 7, 8, 9, *range(21, 30))] + [(None, "columns"), (None, "quoting")], key=str)
