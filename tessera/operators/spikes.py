"""Implausible readings: state-space forecasts of each source, flags on standardised innovations.

The state of a source is its level and a daily wave (cosine and sine), so a forecast knows the hour of the day and how far the
last reading lies back. Readings whose standardised innovation is beyond the threshold are flagged and their update withheld;
three of them in a row are a change of the level, not a spike: the state starts again there. A stuck sensor shows as a vanishing
variance of the innovations of the same filter without wave and measurement noise, whose forecast is the last reading, over the
window of a run.

Noise, drift, resolution and scale are those of the whole source, from mergeable histograms of its differences and innovations.
The filter starts anew every ``span`` readings of a source, after ``halo_rows`` readings to warm up, so a span is judged the same
wherever the readings before and after it lie. A source may hold any share of the rows: its readings are numbered by (source, day)
counts and prefix sums and travel in blocks of spans, many tasks to a source, and a task filters the spans of all its blocks
side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable, known

UNIT_ROWS = 200_000  # readings of a (source, day) beyond which the day is cut into equal times
PRIOR = 24  # readings below which a source borrows from all sources of the field
LOW, HIGH, STEPS = -20, 14, 16  # powers of two of the histograms and bins of a doubling
BINS = (HIGH - LOW) * STEPS + 2


@dataclass(frozen=True)
class SpikeRules:
    """threshold: innovations in robust standard deviations. max_run: the most readings of a spike. run: readings of a stuck sensor.

    span: readings after which the filter starts anew. halo_rows: readings that warm it up. min_scale: the least standard deviation
    that is believed, in units of the resolution of a source. block_rows: readings that travel together, at least a span; it
    decides no result.
    """

    threshold: float = 6.75
    max_run: int = 2
    run: int = 12
    span: int = 512
    block_rows: int = 4096
    halo_rows: int = 96
    period_s: float = 86_400.0
    min_scale: float = 0.5


def _bins(x: np.ndarray) -> np.ndarray:
    """The bin of each absolute value: 0 for none, then a sixteenth of a doubling each."""
    x = np.abs(x)
    at = np.clip(np.floor(np.log2(np.maximum(x, 1e-300)) * STEPS + 0.5) - LOW * STEPS, 0, BINS - 2) + 1
    return np.where(x < 2.0**LOW, 0, at).astype(np.int32)


def _histogram(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the absolute values in each bin; bins add up over parts of a source."""
    at = _bins(x)
    return np.bincount(at, minlength=BINS), np.bincount(at, np.abs(x), minlength=BINS)


def _quantile(count: np.ndarray, total: np.ndarray, q: float) -> float:
    """The value of the bin in which the share ``q`` is reached: its mean, so exact where a bin holds one value."""
    n = count.sum()
    if n <= 0:
        return 0.0
    at = int(np.searchsorted(np.cumsum(count), q * n - 1e-9))
    return float(total[at] / count[at]) if count[at] > 0 else 0.0


def _spread(count: np.ndarray, total: np.ndarray) -> float:
    """A standard deviation around zero that a tenth of the values cannot move: from the median size, or from the ninth tenth where
    half of the values are the same."""
    return max(_quantile(count, total, 0.5) * 1.4826, _quantile(count, total, 0.9) / 1.645)


def _model(one: tuple, two: tuple, min_scale: float, floor: float | None = None) -> tuple[float, float, float]:
    """(noise, drift, least noise), all variances, from the histograms of the differences at distance one and two:
    v1 = 2 noise + drift, v2 = 2 noise + 2 drift. The resolution is the usual smallest difference that is not 0."""
    v1, v2 = _spread(*one) ** 2, _spread(*two) ** 2
    moved = (np.append(0, one[0][1:]), np.append(0.0, one[1][1:]))
    floor = min_scale * _quantile(*moved, 0.1) if floor is None else floor
    low = max(floor * floor, 1e-12)
    return max(v1 - v2 / 2, v1 * 0.1, low), max(v2 - v1, v1 * 0.02, low * 0.05), low


def _rescaled(noise: float, low: float, count: np.ndarray, total: np.ndarray) -> float:
    """The factor that the forecasts' own robust spread puts on the variances."""
    scale = max(_spread(count, total) ** 2, 1e-6)
    return low / noise if noise * scale < low else scale


def filtered(hours: np.ndarray, y: np.ndarray, fair: np.ndarray, noise: np.ndarray, drift: np.ndarray, start: np.ndarray, threshold: float, max_run: int, period_h: float) -> tuple[np.ndarray, np.ndarray]:
    """(standardised innovations, flags of spikes) of many series side by side, one to a row.

    Readings that are not ``fair`` pass time and nothing else. ``start`` is the variance of the first state; ``noise``, ``drift`` and
    ``start`` hold one number for each series.
    """
    m, n = y.shape
    zs, flags = np.zeros((n, m)), np.zeros((n, m), dtype=bool)
    if not m or not n:
        return zs.T, flags.T
    w = 2 * np.pi / period_h
    us, vs = np.cos(w * hours).T.copy(), np.sin(w * hours).T.copy()
    dt = np.clip(np.diff(hours, axis=1, prepend=hours[:, :1]), 0, 10 * period_h).T.copy()
    ys, ok = y.T.copy(), fair.T.copy()
    early = np.where(fair & (np.cumsum(fair, axis=1) <= 24), y, np.nan)
    early[np.isnan(early).all(axis=1), 0] = 0.0
    a, b, c = np.nanmedian(early, axis=1), np.zeros(m), np.zeros(m)
    # The covariance of (level, cosine, sine), six numbers of a symmetric matrix.
    paa, pbb, pcc = start.copy(), start.copy(), start.copy()
    pab, pac, pbc = np.zeros(m), np.zeros(m), np.zeros(m)
    sway = drift * 0.01
    held, at = np.zeros(m, dtype=np.int64), np.zeros((max_run, m), dtype=np.int64)
    for k in range(n):
        d, u, v, here = dt[k], us[k], vs[k], ok[k]
        paa = paa + drift * d
        pbb = pbb + sway * d
        pcc = pcc + sway * d
        ga, gb, gc = paa + u * pab + v * pac, pab + u * pbb + v * pbc, pac + u * pbc + v * pcc
        s = ga + u * gb + v * gc + noise
        e = ys[k] - (a + u * b + v * c)
        t = np.where(here, e / np.sqrt(s), 0.0)
        zs[k] = t
        bad = np.abs(t) > threshold
        update = here
        if bad.any():
            held = np.where(bad, held + 1, np.where(here, 0, held))
            wait = bad & (held <= max_run)
            if wait.any():
                i = np.flatnonzero(wait)
                at[held[i] - 1, i] = k
                flags[k, i] = True
                update = here & ~wait
            new = bad & (held > max_run)
            if new.any():  # a new level, not a spike
                i = np.flatnonzero(new)
                flags[at[:, i], i] = False
                held[i] = 0
                more = np.where(new, e * e, 0.0)
                paa, ga, s = paa + more, ga + more, s + more
        else:
            held[here] = 0
        ka, kb, kc = (np.where(update, g / s, 0.0) for g in (ga, gb, gc))
        a, b, c = a + ka * e, b + kb * e, c + kc * e
        paa, pab, pac = paa - ka * ga, pab - ka * gb, pac - ka * gc
        pbb, pbc, pcc = pbb - kb * gb, pbc - kb * gc, pcc - kc * gc
    return zs.T, flags.T


def kalman_innovations(hours: np.ndarray, y: np.ndarray, threshold: float, max_run: int, period_h: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(standardised innovations, flags of spikes) of one series in time order, without missing values and with noise of its own.

    Fewer than 8 readings say nothing of their noise and have no flags.
    """
    n = len(y)
    if n < 8:
        return np.zeros(n), np.zeros(n, dtype=bool)
    noise, drift, low = _model(_histogram(y[1:] - y[:-1]), _histogram(y[2:] - y[:-2]), 0.0, floor)
    start = max(float(np.var(y)), 4 * noise)
    scale, fair = 1.0, np.ones((1, n), dtype=bool)
    for turn in range(2):
        z, flag = filtered(hours[None], y[None].astype(float), fair, np.array([noise * scale]), np.array([drift * scale]), np.array([start]), threshold, max_run, period_h)
        if turn == 0:
            scale = _rescaled(noise, low, *_histogram(z[0, min(24, n // 4) :]))
    return z[0], flag[0]


def stuck(y: np.ndarray, run: int) -> np.ndarray:
    """Readings of runs of at least ``run`` readings over which the innovations of a filter without measurement noise, whose
    forecast is the last reading, have no variance (nor a mean)."""
    n = len(y)
    out = np.zeros(n, dtype=bool)
    if n < run:
        return out
    innovations = np.diff(y)
    variance = np.lib.stride_tricks.sliding_window_view(innovations * innovations, run - 1).mean(axis=1) if run > 1 else np.zeros(n)
    edge = np.zeros(n + 1, dtype=np.int64)
    first = np.flatnonzero(variance <= 1e-18)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + run, -1)
    return np.cumsum(edge[:n]) > 0


def _units(readings: DataFrame, n_fields: int) -> DataFrame:
    """(source, day, slice, field, at, y, wrong): the different readings of a day of a source in time order, as arrays.

    ``readings`` holds (source, at) and for each field k ``y{k}``, ``wrong{k}``. A day with very many readings is cut by time.
    """
    day = readings.withColumn("day", F.to_date("at"))
    hot = durable(day.groupBy("source", "day").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > UNIT_ROWS).select("source", "day", F.ceil(F.col("c") / UNIT_ROWS).cast("int").alias("slices")))
    second = F.hour("at") * 3600 + F.minute("at") * 60 + F.second("at")
    cut = day.join(known(hot), ["source", "day"], "left").withColumn("slice", F.floor(second * F.coalesce("slices", F.lit(1)) / 86_400).cast("int"))
    once = cut.groupBy("source", "day", "slice").agg(F.collect_set(F.struct("at", *(f"{c}{k}" for k in range(n_fields) for c in ("y", "wrong")))).alias("r"))

    def of(k: int) -> Column:
        there = F.filter("r", lambda x: x[f"y{k}"].isNotNull())
        return F.sort_array(F.transform(there, lambda x: F.struct(x["at"].alias("at"), x[f"y{k}"].alias("y"), x[f"wrong{k}"].alias("wrong"))))

    each = once.select("source", "day", "slice", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), of(k).alias("r")) for k in range(n_fields)))).alias("f"))
    # Equal readings are neighbours now.
    each = each.where(F.size("f.r") > 0).select("source", "day", "slice", "f.field", F.expr("filter(f.r, (x, i) -> i = 0 or x <> get(f.r, i - 1))").alias("r"))
    return each.select("source", "day", "slice", "field", F.size("r").alias("n"), F.col("r.at").alias("at"), F.col("r.y").alias("y"), F.col("r.wrong").alias("wrong"))


def _blocks(units: DataFrame, rules: SpikeRules) -> DataFrame:
    """(source, field, block, first, at, y, wrong): arrays of the readings of each block with the halo before and after it, in order.

    Readings have ranks in time order, from 0, by the sums of the days before; ``first`` is the rank of the first one.
    """
    by = ["source", "field", "day", "slice"]
    before = F.sum("n").over(Window.partitionBy("source", "field").orderBy("day", "slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = units.select(*by, F.coalesce(before, F.lit(0)).alias("start"))
    size = max(1, rules.block_rows // rules.span) * rules.span
    after = max(rules.run - 1, rules.max_run)
    last = F.col("start") + F.col("n") - 1
    of = F.sequence(F.floor(F.greatest(F.col("start") - after, F.lit(0)) / size), F.floor((last + rules.halo_rows) / size))
    rows = units.join(starts, by).withColumn("block", F.explode(of))
    begin = F.greatest(F.col("block") * size - rules.halo_rows - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * size + after - F.col("start"), F.col("n"))
    part = lambda c: F.slice(c, (begin + 1).cast("int"), (end - begin).cast("int")).alias(c)
    parts = rows.where(end > begin).select("source", "field", "block", F.struct((F.col("start") + begin).alias("first"), part("at"), part("y"), part("wrong")).alias("r"))
    packed = parts.groupBy("source", "field", "block").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return packed.select("source", "field", "block", F.get("r", F.lit(0))["first"].alias("first"), *(F.flatten(f"r.{c}").alias(c) for c in ("at", "y", "wrong")))


class _Batch:
    """The spans of a batch of blocks as a matrix, one span to a row, each with its halo."""

    def __init__(self, batch: pa.RecordBatch, rules: SpikeRules, exempt: dict[int, float]):
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        self.batch, self.rules = batch, rules
        lists = column("y")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        self.y = lists.flatten().to_numpy(zero_copy_only=False)
        self.micros = column("at").flatten().cast(pa.int64()).to_numpy(zero_copy_only=False)
        wrong = column("wrong").flatten().to_numpy(zero_copy_only=False).astype(bool)
        self.field = column("field").to_numpy(zero_copy_only=False)
        first, block = column("first").to_numpy(), column("block").to_numpy()
        size = max(1, rules.block_rows // rules.span) * rules.span
        self.row = np.repeat(np.arange(len(first)), np.diff(ends))
        self.rank = np.arange(len(self.row)) - ends[self.row] + first[self.row]
        self.core = self.rank // size == block[self.row]
        # A run cannot go from one block's readings into another's: the innovation between them is not one.
        self.still = np.zeros(len(self.y), dtype=bool)
        for a, b, f in zip(ends[:-1], ends[1:], self.field):
            still = stuck(self.y[a:b], rules.run)
            self.still[a:b] = still & (self.y[a:b] != exempt[f]) if f in exempt else still
        # Impossible and stuck readings are cases already and must not move the state.
        self.fair = ~wrong & ~self.still
        spans = [(k, s) for k in range(len(first)) for s in range(block[k] * size, min((block[k] + 1) * size, first[k] + ends[k + 1] - ends[k]), rules.span)]
        self.of = np.array([k for k, _ in spans], dtype=np.int64)
        begin = np.array([s for _, s in spans], dtype=np.int64)
        width = rules.halo_rows + rules.span + max(rules.run - 1, rules.max_run)
        rank = begin[:, None] - rules.halo_rows + np.arange(width)
        inside = (rank >= first[self.of][:, None]) & (rank < (first + np.diff(ends))[self.of][:, None]) if len(begin) else np.zeros((0, width), dtype=bool)
        self.at = np.where(inside, rank - first[self.of][:, None] + ends[self.of][:, None], 0) if len(begin) else np.zeros((0, width), dtype=np.int64)
        self.inside = inside
        self.own = inside & (rank >= begin[:, None]) & (rank < begin[:, None] + rules.span)

    def differences(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, difference) of core readings to the fair one ``step`` before."""
        at = np.flatnonzero(self.fair)
        if len(at) <= step:
            return at[:0], self.y[:0]
        a, b = at[:-step], at[step:]
        good = (self.row[a] == self.row[b]) & self.core[b]
        return self.row[b][good], self.y[b][good] - self.y[a][good]

    def moments(self) -> pa.RecordBatch:
        """Number, sum and sum of squares of the fair core readings of each block, as the bins 0 and 1 of a third histogram."""
        own = self.core & self.fair
        k = len(self.field)
        n = np.bincount(self.row[own], minlength=k).astype(float)
        sums = [np.bincount(self.row[own], y[own], minlength=k) for y in (self.y, self.y * self.y)]
        two = lambda x: pa.array(np.concatenate([x, x]))
        source = self.batch.column(self.batch.schema.get_field_index("source"))
        columns = [pa.concat_arrays([source, source]), two(self.field.astype(np.int32)), two(np.full(k, 2, dtype=np.int32)), pa.array(np.repeat([0, 1], k).astype(np.int32)), two(n), pa.array(np.concatenate(sums))]
        return pa.RecordBatch.from_arrays(columns, names=["source", "field", "kind", "bin", "n", "s"])

    def run(self, noise: np.ndarray, drift: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(innovations, flags) of the spans under parameters of the blocks."""
        r = self.rules
        hours = self.micros[self.at] / 3.6e9
        # Places outside the series take the time of the nearest reading inside.
        lead = np.argmax(self.inside, axis=1)
        hours = np.where(self.inside, hours, np.where(np.arange(hours.shape[1]) < lead[:, None], hours[np.arange(len(lead)), lead][:, None], -np.inf))
        hours = np.maximum.accumulate(hours, axis=1)
        return filtered(hours, self.y[self.at], self.inside & self.fair[self.at], noise[self.of], drift[self.of], start[self.of], r.threshold, r.max_run, r.period_s / 3600)


_HISTOGRAMS = "source string, field int, kind int, bin int, n double, s double"


def _told(batch: _Batch, kind: int, block: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """The histogram of the values ``x`` of each source and field, as rows of the bins that are not empty."""
    key = block.astype(np.int64) * BINS + _bins(x)
    met, at = np.unique(key, return_inverse=True)
    n, s = np.bincount(at, minlength=len(met)), np.bincount(at, np.abs(x), minlength=len(met))
    rows = met // BINS
    source = batch.batch.column(batch.batch.schema.get_field_index("source")).take(pa.array(rows))
    columns = [source, pa.array(batch.field[rows].astype(np.int32)), pa.array(np.full(len(met), kind, dtype=np.int32)), pa.array((met % BINS).astype(np.int32)), pa.array(n.astype(float)), pa.array(s.astype(float))]
    return pa.RecordBatch.from_arrays(columns, names=["source", "field", "kind", "bin", "n", "s"])


def _dense(pdf: pd.DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The histograms of (field, kind) as arrays, from rows of bins."""
    out: dict = {}
    for (f, k), g in pdf.groupby(["field", "kind"]):
        n, s = np.zeros(BINS), np.zeros(BINS)
        n[g["bin"]], s[g["bin"]] = g["n"], g["s"]
        out[int(f), int(k)] = n, s
    return out


def _each_source(histograms: DataFrame, figures, schema: str) -> DataFrame:
    """``figures`` of the histograms of each (source, field); a source with few readings borrows from the
    field, so that it holds as many as PRIOR."""
    summed = durable(histograms.groupBy("source", "field", "kind", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    pooled = _dense(summed.groupBy("field", "kind", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas())  # a few bins of each field
    none = (np.zeros(BINS), np.zeros(BINS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, field, h in zip(pdf["source"], pdf["field"], pdf["h"]):
                own = {"n": sum(e["n"] for e in h if e["kind"] == 2 and e["bin"] == 0)}
                for k in range(3):
                    n, s = np.zeros(BINS), np.zeros(BINS)
                    for e in h:
                        if e["kind"] == k:
                            n[e["bin"]], s[e["bin"]] = e["n"], e["s"]
                    all_n, all_s = pooled.get((field, k), none)
                    if n.sum() < PRIOR and all_n.sum() > 0:
                        share = (PRIOR - n.sum()) / all_n.sum()
                        n, s = n + all_n * share, s + all_s * share
                    own[k] = n, s
                rows.append((source, field, *figures(own)))
            yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in f"source string, field int, {schema}".split(", ")]
    lists = summed.groupBy("source", "field").agg(F.collect_list(F.struct("kind", "bin", "n", "s")).alias("h"))
    return durable(lists.mapInPandas(run, f"source string, field int, {schema}"))


def implausible_readings(
    df: DataFrame,
    key: str,
    source: str,
    at: str,
    fields: Sequence[str],
    impossible: dict[str, Column],
    missing: float = 999.9,
    stuck_exempt: dict[str, float] | None = None,
    rules: SpikeRules = SpikeRules(),
    name: str = "field_name",
) -> DataFrame:
    """(key, name): each reading that is a spike, stuck or impossible; no row twice.

    Null, NaN and ``missing`` values are not measured and are never a case; runs, spans and halos count measured readings only.
    ``impossible`` holds a condition for each field, over the columns ``fields`` of the same row after missing values became null.
    Readings without source or time can only be impossible. Repeats of a reading (same source, time and values) count once in the
    series, and all of them come out. ``stuck_exempt`` is a value for a field at which a sensor may rest. A source of fewer than 24
    readings of a field borrows its noise from all sources of that field; where these together are fewer than 8, no spike is told.
    """
    exempt = {k: (stuck_exempt or {})[c] for k, c in enumerate(fields) if c in (stuck_exempt or {})}
    clean = [F.when(~F.isnan(F.col(c)) & (F.col(c) != missing), F.col(c).cast("double")).alias(c) for c in fields]
    rows = df.select(F.col(key).alias("__key"), F.col(source).cast("string").alias("__source"), F.col(at).cast("timestamp_ntz").alias("__at"), *clean)
    wrong = {c: F.coalesce(impossible[c], F.lit(False)) if c in impossible else F.lit(False) for c in fields}
    tell = [F.when(wrong[c], F.lit(c)) for c in fields]
    by_row = rows.select("__key", F.explode(F.array_compact(F.array(*tell))).alias("__field"))

    placed = rows.where(F.col("__source").isNotNull() & F.col("__at").isNotNull())
    values = [x for k, c in enumerate(fields) for x in (F.col(c).alias(f"y{k}"), wrong[c].alias(f"wrong{k}"))]
    units = durable(_units(placed.select(F.col("__source").alias("source"), F.col("__at").alias("at"), *values), len(fields)))
    blocks = durable(_blocks(units, rules))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, rules, exempt)
            yield _told(b, 0, *b.differences(1))
            yield _told(b, 1, *b.differences(2))
            yield b.moments()

    def first_figures(own: dict) -> tuple[float, ...]:
        noise, drift, low = _model(own[0], own[1], rules.min_scale)
        (n, s) = own[2]
        variance = s[1] / max(n[1], 1) - (s[0] / max(n[0], 1)) ** 2
        return noise, drift, low, max(float(variance), 4 * noise), float(own[0][0].sum()), float(own["n"])

    first = _each_source(blocks.mapInArrow(differences, _HISTOGRAMS), first_figures, "noise double, drift double, low double, start double, seen double, n double").where("seen >= 7")

    def of(b: _Batch, c: str) -> np.ndarray:
        return b.batch.column(b.batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)

    def innovations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, rules, exempt)
            z = b.run(of(b, "noise"), of(b, "drift"), of(b, "start"))[0]
            warm = b.own & b.fair[b.at] & (b.rank[b.at] >= np.minimum(24, of(b, "n")[b.of] // 4)[:, None])
            yield _told(b, 0, np.broadcast_to(b.of[:, None], warm.shape)[warm], z[warm])

    judged = blocks.join(known(first), ["source", "field"])
    scale = _each_source(judged.mapInArrow(innovations, _HISTOGRAMS), lambda own: (_spread(*own[0]) ** 2,), "factor double")
    figures = known(first.join(scale, ["source", "field"], "left").withColumn("factor", F.expr("if(noise * greatest(coalesce(factor, 1D), 1e-6D) < low, low / noise, greatest(coalesce(factor, 1D), 1e-6D))")))

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, rules, exempt)
            factor = of(b, "factor").copy()
            judged = ~np.isnan(factor)
            factor[~judged] = 1.0
            noise, drift, start = (np.where(judged, of(b, c), 1.0) for c in ("noise", "drift", "start"))
            flags = b.run(noise * factor, drift * factor, start)[1] & b.own & judged[b.of][:, None]
            hit = b.still & b.core
            hit[b.at[flags]] = True
            hit = np.flatnonzero(hit)
            source = batch.column(batch.schema.get_field_index("source")).take(pa.array(b.row[hit]))
            columns = [source, pa.array(b.micros[hit]).cast(pa.timestamp("us")), pa.array(b.field[b.row[hit]].astype(np.int32)), pa.array(b.y[hit])]
            yield pa.RecordBatch.from_arrays(columns, names=["__source", "__at", "__index", "__value"])

    found = blocks.join(figures, ["source", "field"], "left").mapInArrow(cases, "__source string, __at timestamp_ntz, __index int, __value double")
    # A reading may be in the series twice, once as wrong by another field of its row.
    flagged = known(durable(found.distinct()))
    value = F.coalesce(*(F.when(F.col("__index") == k, F.col(c)) for k, c in enumerate(fields)))
    told = F.get(F.lit(list(fields)), F.col("__index"))
    by_series = placed.join(flagged, ["__source", "__at"]).where(value == F.col("__value")).select("__key", told.alias("__field"))
    return by_row.unionByName(by_series).distinct().select(F.col("__key").alias(key), F.col("__field").alias(name))
