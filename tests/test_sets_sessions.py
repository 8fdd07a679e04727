import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import numeric, times
from tessera.operators import regions, sessions, sets

T0 = dt.datetime(2022, 1, 1)


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "k int, v string")
    names = spark.createDataFrame([(1, 10), (1, 9), (None, 7), (4, None)], "bad int, good int")
    assert [r["k"] for r in sets.looked_up(df, "k", names, "bad", "good").orderBy("v").collect()] == [9, 2, None, 4]
    strict = sets.strictly_looked_up(df.where("k = 1"), "k", names.where("good = 9"), "bad", "good", "name")
    assert strict.collect()[0]["name"] == 9
    with pytest.raises(PySparkException):
        sets.strictly_looked_up(df, "k", names.where("good = 9"), "bad", "good", "name").collect()


def test_splits_and_tops(spark):
    df = spark.createDataFrame([(u, i, i % 3) for u in (1, 2) for i in range(10 * u)], "u int, i int, x int")
    parts = sets.split_by_group(df, "u", ["i"], 0.9)
    assert {(r["u"], r["part"]): r["count"] for r in parts.groupBy("u", "part").count().collect()} == {(1, "train"): 9, (1, "test"): 1, (2, "train"): 18, (2, "test"): 2}
    a, b = sets.split_by_hash(df, ["u", "i"], [0.7, 0.3])
    assert a.count() + b.count() == 30 and a.join(b, ["u", "i"]).count() == 0
    top = sets.top_per_group(df, "u", 2, F.desc("x"), "i").orderBy("u", "rank").collect()
    assert [(r["u"], r["i"], r["rank"]) for r in top] == [(1, 2, 1), (1, 5, 2), (2, 2, 1), (2, 5, 2)]
    assert {r["u"] for r in sets.active(df, "u", 11).collect()} == {2}
    assert sets.overlap(df, df.where("i < 3"), "i").first()["n"] == 3
    assert sets.flagged(df, df.where("i = 1"), ["u", "i"]).agg(F.sum("held")).first()[0] == 2
    assert sets.rows_not_of(df, df.where("u = 1"), "u").count() == 20


def test_union_counts_stats_and_fill(spark):
    df = spark.createDataFrame([("a", "b"), ("b", ""), (None, "b")], "x string, y string")
    assert {r["value"]: r["n"] for r in sets.united_counts(df, ["x", "y"]).collect()} == {"a": 1, "b": 3}
    s = sets.described(spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double"), "v").first()
    assert (s["n"], s["mean"], s["stdev"], s["max"], s["min"], s["sum"]) == (2, 2.0, 1.0, 3.0, 1.0, 4.0)
    assert [r["y"] for r in sets.filled(df, "y", F.lit("z")).collect()] == ["b", "z", "b"]
    assert {(r["x"], r["y"]): r["n"] for r in sets.pair_key_counts(df, "x", "y").collect()} == {("a", "b"): 1, ("", "b"): 1}


def test_sessions_split_at_exactly_the_gap(spark):
    at = [0, 60, 60 + 239, 60 + 239 + 240, 2000]
    df = spark.createDataFrame([("k", k, T0 + dt.timedelta(minutes=m)) for k, m in enumerate(at)] + [("k", 9, None)], "key string, id int, t timestamp_ntz").where("t is not null")
    s = sessions.sessions(df, "key", "t", "id", 4)
    assert [r["session"] for r in s.orderBy("id").collect()] == [1, 1, 1, 2, 3]
    n = sessions.with_next(s, "key", "t", "id", ["t"]).withColumn("e", F.col("t") + F.expr("interval '90' second"))
    i = sessions.idle(n, ["key"], "e", "next_t").first()
    assert (i["n"], i["idle_minutes"]) == (2, 296) and i["mean_minutes"] == 148.0


def test_durations_truncate_to_zero(spark):
    df = spark.createDataFrame([(T0, T0 + dt.timedelta(seconds=s)) for s in (3599, 3600, -3599, -3601, 0)], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(times.whole_hours(F.col("b"), F.col("a")).alias("h"), times.whole_minutes(F.col("b"), F.col("a")).alias("m")).collect()
    assert [r["h"] for r in got] == [0, 1, 0, -1, 0] and [r["m"] for r in got] == [59, 60, -59, -60, 0]


def test_haversine_and_vectors(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, [3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a double, b double, c double, d double, x array<double>, y array<double>, z array<double>")
    r = df.select(numeric.haversine_m(*(F.col(k) for k in "abcd")).alias("m"), numeric.cosine(F.col("x"), F.col("y")).alias("c"), numeric.cosine(F.col("x"), F.col("z")).alias("n"), numeric.distance(F.col("x"), F.col("y")).alias("d")).first()
    assert abs(r["m"] - 111194.9) < 1 and abs(r["c"] - 0.96) < 1e-12 and r["n"] is None and abs(r["d"] - 2**0.5) < 1e-12


BIG = '{"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10]]]}'
SMALL = '{"type": "Polygon", "coordinates": [[[1, 1], [3, 1], [3, 3], [1, 3]]]}'


def test_region_priority_and_trips(spark):
    zones = spark.createDataFrame([("z1", 2, "two", BIG), ("z2", 1, "small", SMALL), ("z3", 2, "other", SMALL), ("z4", 1, "none", None)], "z string, c int, b string, g string")
    reg = regions.region_table(zones, "z", "c", "b", "g")
    assert [r["name"] for r in reg.orderBy("priority").collect()] == ["z2", "z4", "z1", "z3"]
    hour = dt.timedelta(hours=1)
    trips = [(1, T0, T0 + hour / 2, 2.0, 2.0, 9.0, 9.0), (2, T0, T0 + hour, 9.0, 9.0, 8.0, 8.0), (3, T0, T0 + 3 * hour, 2.0, 2.0, 2.0, 2.0), (4, T0, T0 + hour, 0.0, 0.0, 2.0, 2.0), (5, T0, T0 + hour, None, 2.0, 50.0, 50.0)]
    df = spark.createDataFrame(trips, "trip_id long, pickup_time timestamp_ntz, dropoff_time timestamp_ntz, pickup_lon double, pickup_lat double, dropoff_lon double, dropoff_lat double")
    t = regions.with_regions(regions.clean_trips(df), reg)
    assert {r["trip_id"]: (r["pickup_region"], r["dropoff_region"]) for r in t.collect()} == {1: ("small", "two"), 2: ("two", "two"), 5: (None, None)}
    same, other = regions.duration_stats(t.where(regions.same_region())).first(), regions.duration_stats(t.where(~regions.same_region())).first()
    assert same["n"] == 2 and other["n"] == 1 and same["n"] + other["n"] == regions.duration_stats(t, ["dropoff_region"]).agg(F.sum("n")).first()[0]


def test_validity_and_parsing(spark):
    df = spark.createDataFrame([(1, "04/05/2021", "7:05", "a", None), (-1, "04/05/2021", "7:05", "a", "b"), (1, "x", "25:00", "a", ""), (0, "01/01/2022", "23:59", None, " "), (None, None, None, None, None)], "n int, d string, t string, a string, b string")
    told = df.select("*", times.parsed_date(F.col("d")).alias("day"), times.minutes_of_day(F.col("t")).alias("m"))
    assert [r["m"] for r in told.collect()] == [425, 425, None, 1439, None] and [r["day"] is None for r in told.collect()] == [False, False, True, False, True]
    got = sets.valid_rows(told, ["n"], {"day": (dt.date(2021, 1, 1), dt.date(2022, 12, 31))}, ["a", "b"]).collect()
    assert [r["n"] for r in got] == [1]


def test_samples_by_key_can_be_taken_again(spark):
    from tessera.operators import sets

    df = spark.range(5000).withColumn("x", F.col("id") % 3)
    a, b = ({r["id"] for r in sets.sampled_by_key(d, ["id"], 0.2, 5).collect()} for d in (df, df.repartition(7)))
    assert a == b and 850 < len(a) < 1150 and a != {r["id"] for r in sets.sampled_by_key(df, ["id"], 0.2, 6).collect()}
    parts = sets.split_by_hash(df, ["id"], [1, 1, 2], 1)
    assert sum(p.count() for p in parts) == 5000 and sets.sampled_by_key(df.limit(0), ["id"], 0.5).count() == 0
