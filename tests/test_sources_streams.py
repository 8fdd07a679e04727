import datetime as dt
import json

from pyspark.sql import functions as F

from tessera import sinks
from tessera.operators import records
from tessera.sources import readers as R
from tessera.streaming import counts as S

# Four records built by the offsets of the format, and what they hold.
GOLDEN = [
    (2022, 4, 13, 0, 49.633, 6.233, 367, 210, 3.0, 120, 6000, 9.5, 10.0),
    (2022, 4, 14, 0, 49.627, 6.212, 376, 160, 2.1, 732, 2800, 9.0, 10.0),
    (2022, 4, 15, 0, 49.627, 6.212, 376, 190, 2.1, 30, 2000, 9.0, 10.0),
    (2022, 4, 16, 1, 49.633, 6.233, 367, 190, 2.0, 30, 2600, 9.4, 9.7),
]


def weather_line(y, mo, d, h, lat, lon, el, di, sp, ce, vi, dew, air):
    t = lambda x, s: round(x * s)
    return f"{'0' * 15}{y:04d}{mo:02d}{d:02d}{h:02d}000{t(lat, 1000):+06d}{t(lon, 1000):+07d}FM-12{el:+05d}{'0' * 9}{di:03d}1N{t(sp, 10):04d}1{ce:05d}1CN{vi:06d}1N1{t(air, 10):+05d}1{t(dew, 10):+05d}1"


def test_fixed_width(spark):
    lines = [weather_line(*g) for g in GOLDEN]
    missing = lines[0][:87] + "+9999" + lines[0][92:]
    calm = lines[1][:65] + "9999" + lines[1][69:]
    df = spark.createDataFrame([(x,) for x in [*lines, missing, calm, "short"]], "line string")
    got = [tuple(r) for r in R.weather_records(df, "line").where("obs_year is not null").collect()]
    assert got[:4] == GOLDEN and len(got) == 5 and got[4][8] == 999.9
    assert [r["speed_rate"] for r in R.weather_records(df, "line", drop_sentinels=True).where("obs_year is not null").collect()][4] is None


def test_delimited_and_safe(spark):
    df = spark.createDataFrame([("1\t2",), ("x\t3",), ("5",), (None,)], "line string")
    got = [tuple(r) for r in R.split_fields(df, "line", "\t", [("a", "int"), ("b", "int")]).collect()]
    assert got == [(1, 2), (None, 3), (5, None), (None, None)]
    good, bad = R.safely_parsed(df, "line", {"a": F.get(F.split("line", "\t"), F.lit(0)).try_cast("int"), "b": F.get(F.split("line", "\t"), F.lit(1)).try_cast("int")})
    assert [tuple(r) for r in good.collect()] == [(1, 2)] and {r["failed"] for r in bad.collect()} == {"a", "b", "a,b"}
    q = spark.createDataFrame([('a,"b, ""c""",d',)], "line string").select(R.quoted_fields(F.col("line")).alias("f")).first()["f"]
    assert q == ["a", 'b, "c"', "d"] and R.without_header(df, "line", "5").count() == 3


def test_stitched_records(spark):
    rows = [("noise", 0), ('1990,a,"one', 1), ("two", 2), ('three"', 3), ("1991,b,x", 4)]
    got = [r["value"] for r in R.stitched_records(spark.createDataFrame(rows, "v string, n int"), "v", "n").orderBy("record").collect()]
    assert got == ['1990,a,"one\ntwo\nthree"', "1991,b,x"]
    assert spark.createDataFrame([(got[0],)], "v string").select(records.fields(F.col("v")).alias("f")).first()["f"][2] == "one\ntwo\nthree"


def test_files_in_and_out(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([("word", "a", 2), ("number", "1", 3)], "token_class string, token string, n int")
    sinks.by_class(df, f"{p}/cls")
    assert {r["value"] for r in R.text_lines(spark, f"{p}/cls/token_class=word").collect()} == {"a\t2"}
    sinks.delimited(df, f"{p}/csv", header=True, single_file=True)
    assert R.csv_table(spark, f"{p}/csv", df.schema).count() == 2 and R.csv_table(spark, f"{p}/csv").schema["n"].dataType.simpleString() == "int"
    sinks.columnar(df, f"{p}/pq", ["token_class"])
    assert spark.read.parquet(f"{p}/pq").where("token_class = 'word'").count() == 1
    sinks.dumped(df, f"{p}/dump")
    assert {r["value"] for r in R.text_lines(spark, [f"{p}/dump", f"{p}/cls/token_class=number"]).collect()} == {"word,a,2", "number,1,3", "1\t3"}
    assert R.text_lines(spark, f"{p}/du*").count() == 2 and R.text_lines(spark, f"{p}/dump,{p}/dump").count() == 4
    w = R.whole_files(spark, f"{p}/dump").collect()
    assert all(r["path"].endswith(r["file"]) for r in w)
    calls = []
    for _ in range(2):
        assert R.built_once(spark, f"{p}/cache", ["x"], lambda: calls.append(1) or df).count() == 2
    assert len(calls) == 1 and R.from_rows(spark, [(1,)], "k int").count() == 1


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"properties": {"boroughCode": 1, "borough": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1]]]}}]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    r = R.geojson_features(spark, str(tmp_path / "r.json")).first()
    assert r["properties"]["borough"] == "x" and json.loads(r["geometry"])["type"] == "Polygon"


def test_streams_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2022, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=k), "ab"[k % 2], "x #A #b" if k % 3 else None) for k in range(30)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, kind string, text string")
    df.repartition(3).write.parquet(str(tmp_path / "s"))
    read = lambda: S.file_stream(spark, str(tmp_path / "s"), df.schema, "*.parquet", 1)
    assert {tuple(r) for r in S.run_counts(S.value_counts(read(), "kind"), "t1").collect()} == {("a", 15), ("b", 15)}
    assert {tuple(r) for r in S.run_counts(S.hashtag_counts(read(), "text"), "t2").collect()} == {("#a", 20), ("#b", 20)}
    assert {tuple(r) for r in S.run_counts(S.hashtag_pairs(read(), "text"), "t3").collect()} == {("#a", "#b", 20)}
    assert sum(r["n"] for r in S.run_counts(S.windowed_counts(read(), "ts", "kind", "10 minutes"), "t4").collect()) == 30
    seen = []
    q = S.each_batch(read(), lambda b, k: seen.append(b.count()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(seen) == 30


def test_quoted_fields_of_long_and_open_lines(spark):
    f = lambda x: spark.createDataFrame([(x,)], "v string").select(R.quoted_fields(F.col("v")).alias("f")).first()["f"]
    assert len(f(",".join(['"a,b"', "c"] * 20_000))) == 40_000
    assert f('a,"b,c') == ["a", '"b,c'] and f("") == [""] and f(",") == ["", ""]
    assert spark.createDataFrame([('a|"b|c"',)], "v string").select(R.quoted_fields(F.col("v"), "|").alias("f")).first()["f"] == ["a", "b|c"]


def test_stitched_records_over_blocks_and_files(spark):
    rows = [(f, n, f"1990,{f}{n}" if n % 7 == 0 else f"x{n}") for f in ("a", "b", None) for n in range(100)]
    df = spark.createDataFrame(rows, "f string, n long, v string")
    got = {(r["file"], r["record"]): r["value"] for r in R.stitched_records(df, "v", "n", "f", block_lines=10).collect()}
    assert len(got) == 45 and got[("a", 2)] == "\n".join(["1990,a7", *(f"x{n}" for n in range(8, 14))]) and got[(None, 15)] == "1990,None98\nx99"
    assert R.stitched_records(df.limit(0), "v", "n", "f").count() == 0
