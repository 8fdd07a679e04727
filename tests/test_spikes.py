import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import spikes as K

T0 = dt.datetime(2022, 1, 1)


def series(n=600, seed=0, noise=0.4):
    rng = np.random.default_rng(seed)
    h = np.arange(n, dtype=float)
    return h, np.round(15 + 5 * np.sin(2 * np.pi * h / 24) + rng.normal(0, noise, n) + np.cumsum(rng.normal(0, 0.1, n)), 1)


def test_filter_finds_spikes_and_keeps_level_shifts():
    h, y = series()
    y[100] += 12
    y[200:202] -= 15
    y[400:] += 20  # a new level
    z, flag = K.kalman_innovations(h, y, 7.0, 2, 24.0, 0.05)
    assert set(np.flatnonzero(flag)) == {100, 200, 201}
    assert np.abs(z[np.r_[30:100, 110:200]]).max() < 7


def test_filter_on_short_and_constant_series():
    for y in (np.empty(0), np.ones(3), np.full(50, 2.5)):
        z, flag = K.kalman_innovations(np.arange(len(y), dtype=float), y, 7.0, 2, 24.0, 0.0)
        assert not flag.any() and len(z) == len(y)


def test_stuck_runs():
    y = np.array([1.0] * 11 + [2.0] + [3.0] * 12 + [4.0, 5.0])
    assert K.stuck(y, 12).nonzero()[0].tolist() == list(range(12, 24)) and not K.stuck(y[:11], 12).any()


def rows(n=400, station="A"):
    h, y = series(n)
    return [[station, T0 + dt.timedelta(hours=int(k)), float(v), float(5 + (k % 7) / 10)] for k, v in zip(h, y)]


def judged(spark, data, rules=K.SpikeRules()):
    df = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(data)], "obs_id long, station string, at timestamp_ntz, temp double, wind double, field_name string")
    bad = {"temp": (F.col("temp") > 60) | (F.col("temp") < -90), "wind": F.col("wind") < 0}
    out = K.implausible_readings(df, "obs_id", "station", "at", ["temp", "wind"], bad, 999.9, {"wind": 0.0}, rules).collect()
    got = [(r["obs_id"], r["field_name"]) for r in out]
    assert len(got) == len(set(got))
    return set(got)


def planted():
    data = rows()
    data[50][2] += 25
    for k in range(120, 135):
        data[k][2] = 17.3
    for k in range(200, 230):
        data[k][3] = 0.0
    data[300][2], data[310][2], data[311][2], data[320][3] = 95.0, 999.9, None, -3.0
    want = {(50, "temp"), (300, "temp"), (320, "wind"), *((k, "temp") for k in range(120, 135))}
    return data, want


def test_cases_and_repeats_in_any_block_size(spark):
    data, want = planted()
    n = len(data)
    data += [list(data[50]), list(data[125]), list(data[10])]  # deliveries again, out of order
    want |= {(n, "temp"), (n + 1, "temp")}
    data += [[None, T0, 20.0, 1.0], ["A", None, 99.0, 1.0], ["B", T0, float("nan"), None]]
    want |= {(n + 4, "temp")}
    for rules in (K.SpikeRules(), K.SpikeRules(block_rows=64)):
        assert judged(spark, data, rules) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "obs_id long, station string, at timestamp_ntz, temp double")
    assert K.implausible_readings(df, "obs_id", "station", "at", ["temp"], {"temp": F.col("temp") > 60}).count() == 0


def test_parameters_are_of_the_source_and_not_of_the_block(spark):
    rng = np.random.default_rng(4)
    y = np.round(15 + 3 * np.sin(np.arange(5000) * np.pi / 12) + np.where(np.arange(5000) < 4000, rng.normal(0, 2, 5000), rng.normal(0, 0.3, 5000)), 1)
    y[4300] += 9
    y[1000] += 40
    y[2045:2060] = 11.1  # over the end of a span and of a block
    data = [["A", T0 + dt.timedelta(hours=k), float(v), None] for k, v in enumerate(y)]
    found = [judged(spark, data, K.SpikeRules(block_rows=b)) for b in (64, 4096, 8192)]
    assert found[0] == found[1] == found[2]
    assert {(k, "temp") for k in (1000, *range(2045, 2060))} <= found[0]


def test_few_measured_readings_among_many_missing_ones(spark):
    data = [["A", T0 + dt.timedelta(hours=k), 20.0 + k % 7 if k % 50 == 0 else None, None] for k in range(9000)]
    for k in range(3000, 3000 + 50 * 13, 50):
        data[k][2] = 33.0
    assert judged(spark, data, K.SpikeRules(span=64, block_rows=64)) == {(k, "temp") for k in range(3000, 3000 + 50 * 13, 50)}


def test_short_series_borrow_their_noise(spark):
    short = [["B", T0 + dt.timedelta(hours=k), v, None] for k, v in enumerate([10.0, 10.2, 10.1, 10.0, 39.0, 10.1])]
    assert judged(spark, short) == set()  # nothing to hold it against
    data = rows() + short
    assert judged(spark, data) == {(404, "temp")}


def test_very_many_readings_in_a_day_are_cut_by_time(spark, monkeypatch):
    data, want = planted()
    monkeypatch.setattr(K, "UNIT_ROWS", 7)
    assert judged(spark, data) == want


def test_many_series_side_by_side_are_as_each_alone():
    both = [series(300, s) for s in (1, 2)]
    both[0][1][50] += 15
    one = np.ones(2)
    z, flag = K.filtered(np.array([h for h, _ in both]), np.array([y for _, y in both]), np.ones((2, 300), dtype=bool), one * 0.2, one * 0.1, one * 9, 6.0, 2, 24.0)
    for k, (h, y) in enumerate(both):
        alone = K.filtered(h[None], y[None], np.ones((1, 300), dtype=bool), one[:1] * 0.2, one[:1] * 0.1, one[:1] * 9, 6.0, 2, 24.0)
        assert np.allclose(z[k], alone[0][0]) and (flag[k] == alone[1][0]).all()
    assert flag[0, 50] and not flag[1].any()
