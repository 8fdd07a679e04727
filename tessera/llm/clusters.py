"""Similarity clusters: a Gaussian mixture with a noise component, fitted by distributed expectation-maximisation.

Features are standardised, array by array, and reduced by principal components. All lengths are measured in the radius of a group:
the root mean square distance of members from their centre. It is first read from the distances of some rows to all rows, which
stand still between the own group and the next one, and then measured on all rows under the fitted mixture; the fit is repeated
while the two disagree. So groups that are close on the scale of the table, but far apart on their own, stay apart. (A radius and
not each component's own covariance decides what is apart, because a feature of few values has no variance inside most groups and
would cut off the odd member in it. The covariances decide only whether two pieces of a wide group are one.)

Rows are summed up in fine cells of the standardised features (count and mean), so a hot cluster costs its cells and not its rows,
and the cells lie in the order of the first principal component, so a task meets few components and hands on few moments. The
mixture grows in rounds from the places where the noise component still holds mass, and by cutting components that are too wide; a
round counts only if it lowers the Bayesian information criterion, components that the criterion does not pay for are dropped, and
each round runs until the likelihood settles. The search ends when no place is left that would make a component. What the driver
holds is bounded by ``most_components``, ``candidates``, ``probes`` and the number of features, never by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable

LEAF = 512  # rows of a box
LEAST_RADIUS = 0.01  # of a group, in standard deviations of the table: copies of one record have none
STEPS = 4  # bins of a doubling of distance


@dataclass(frozen=True)
class MixtureRules:
    """Lengths are in radii of a group. floor: the least standard deviation of a component (regularises the covariance). cell: width
    of the cells that sum up rows. apart: means nearer than this are one component. overlap: so are means nearer than this times
    the sum of the two standard deviations along their line.

    explained: share of the variance that the reduced features keep at least. min_members: of a cluster. settle: gain of the
    log-likelihood per row below which a round has settled. candidates: places that are looked at together; all are looked at.
    most_components: beyond it the fit ends with an error. probes: rows whose distances to all rows give the first radius.
    radius: the first radius itself, in standard deviations of the table; None measures it.
    """

    floor: float = 0.6
    cell: float = 2.0
    apart: float = 4.8
    overlap: float = 2.0
    explained: float = 0.99
    min_members: int = 5
    settle: float = 1e-4
    candidates: int = 2000
    most_components: int = 8192
    probes: int = 64
    radius: float | None = None


def _boxes(x: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in boxes of at most LEAF neighbours: halves along the widest side."""
    stack = [np.arange(len(x))] if len(x) else []
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            yield rows
            continue
        part = x[rows]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argpartition(part[:, side], len(rows) // 2)
        stack += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


@dataclass
class Mixture:
    """The fitted model: centring and scale of the features, projection, components and the weight and density of the noise."""

    centre: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    log_noise: float
    noise: float = 1.0
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    mean: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    cov: np.ndarray = field(default_factory=lambda: np.empty((0, 0, 0)))

    def copy(self, **changes) -> Mixture:
        return Mixture(**({k: getattr(self, k) for k in self.__dataclass_fields__} | changes))

    def prepared(self) -> tuple:
        """(inverse factors, log constants, reach) of the components: beyond its reach, squared, a component is below the noise by
        a factor that no double tells from 0."""
        d = self.mean.shape[1]
        low = np.linalg.cholesky(self.cov) if len(self.weight) else np.empty((0, d, d))
        const = np.log(self.weight) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1) - 0.5 * d * np.log(2 * np.pi)
        widest = np.linalg.eigvalsh(self.cov)[:, -1] if len(self.weight) else np.empty(0)
        reach = 2 * widest * np.maximum(const - np.log(max(self.noise, 1e-12)) - self.log_noise + 40, 0)
        return np.linalg.inv(low) if len(low) else low, const, reach

    def log_joint(self, x: np.ndarray, ready: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, components, log(weight * density)) box by box; the last column is the noise. ``x`` is reduced.

        A component is worked out only for boxes within its reach, so the cost follows the components near a row.
        """
        factor, const, reach = ready or self.prepared()
        for rows in _boxes(x):
            part = x[rows]
            gap = np.maximum(np.maximum(part.min(axis=0) - self.mean, self.mean - part.max(axis=0)), 0) if len(const) else np.empty((0, 1))
            near = np.flatnonzero((gap * gap).sum(axis=1) <= reach + 1e-9)
            out = np.full((len(rows), len(near) + 1), np.log(max(self.noise, 1e-12)) + self.log_noise)
            for k, j in enumerate(near):
                y = (part - self.mean[j]) @ factor[j].T
                out[:, k] = const[j] - 0.5 * (y * y).sum(axis=1)
            yield rows, near, out

    def shares(self, x: np.ndarray, ready: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, components, responsibilities, log density) box by box; the last responsibility is the noise's."""
        for rows, near, joint in self.log_joint(x, ready):
            top = joint.max(axis=1, keepdims=True)
            e = np.exp(joint - top)
            total = e.sum(axis=1, keepdims=True)
            yield rows, near, e / total, (top + np.log(total))[:, 0]


def complete_vectors(df: DataFrame, key: str, arrays: Sequence[tuple[str, int]]) -> DataFrame:
    """(key, v): the arrays of each record end to end, where each has its length and holds no null or NaN.

    Records with a null key or an incomplete array take no part. Of several rows of a key the least complete vector counts.
    """
    ok = F.col(key).isNotNull()
    parts = []
    for c, n in arrays:
        a = F.col(c).cast("array<double>")
        ok = ok & F.coalesce((F.size(a) == n) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
        parts.append(a)
    return df.where(ok).select(F.col(key).alias("key"), F.concat(*parts).alias("v")).groupBy("key").agg(F.min("v").alias("v"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as arrays."""
    x = np.ascontiguousarray(x, dtype=float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _sums(k: np.ndarray | list, a: np.ndarray | list) -> pa.RecordBatch:
    """(k, a) as a batch of ``SUMS``."""
    if isinstance(a, list):
        return pa.RecordBatch.from_arrays([pa.array(k, type=pa.int32()), pa.array(a, type=pa.list_(pa.float64()))], names=["k", "a"])
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(k, dtype=np.int32)), _lists(a)], names=["k", "a"])


def _summed(df: DataFrame) -> dict[int, np.ndarray]:
    """The sums of the arrays (k, a) over k, element by element; a task hands on one array for each k it met."""
    add = F.expr("aggregate(slice(l, 2, greatest(size(l) - 1, 0)), l[0], (x, y) -> zip_with(x, y, (p, q) -> p + q))")
    lists = df.groupBy("k").agg(F.array_sort(F.collect_list("a")).alias("l"))
    return {int(r["k"]): np.array(r["a"]) for r in lists.select("k", add.alias("a")).collect()}


SUMS = "k int, a array<double>"


def _standard(rows: DataFrame, lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(centre, scale, variances and directions of the principal components, number of rows) from the moments of all rows.

    The elements of an array are of one unit and share its scale, so one that hardly varies is not blown up.
    """
    width = sum(lengths)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "v")
                n, one, two = n + len(x), one + x.sum(axis=0), two + x.T @ x
        yield _sums([0], np.concatenate([[n], one, two.ravel()])[None])

    a = _summed(rows.select("v").mapInArrow(moments, SUMS)).get(0, np.zeros(1 + width + width * width))
    n = int(a[0])
    centre = a[1 : width + 1] / max(n, 1)
    cov = a[width + 1 :].reshape(width, width) / max(n, 1) - np.outer(centre, centre)
    block = np.repeat(np.arange(len(lengths)), lengths)
    scale = np.sqrt(np.maximum(np.bincount(block, np.diag(cov)) / np.bincount(block), 0))[block]
    scale[scale < 1e-9] = 1.0
    value, vector = np.linalg.eigh(cov / np.outer(scale, scale))
    return centre, scale, np.maximum(value[::-1], 0), vector[:, ::-1], n


def _reduced(centre: np.ndarray, scale: np.ndarray, value: np.ndarray, vector: np.ndarray, radius: float, rules: MixtureRules) -> Mixture:
    """A mixture of noise alone over the reduced features. A direction is left out only if it tells no groups apart: the rest of the
    variance is small and it varies no more than inside a group."""
    total = value.sum()
    d = int(np.searchsorted(np.cumsum(value) / total, rules.explained - 1e-12) + 1) if total > 0 else 1
    d = min(len(value), max(d, int((value > 4 * radius**2 / len(value)).sum())))
    log_volume = np.log(8 * np.sqrt(np.maximum(value[:d], (rules.floor * radius) ** 2))).sum()
    return Mixture(centre, scale, vector[:, :d], -float(log_volume), mean=np.empty((0, d)), cov=np.empty((0, d, d)))


def _first_radius(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, n: int, rules: MixtureRules) -> float:
    """The radius of a group as some rows see it: each probe's distances to all rows, counted by size, stand still where its group
    ends. Probes without such a place (loners) have no say; if none has one the radius is a quarter of a standard deviation."""
    probes = np.array([r["v"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(rules.probes).select("v").collect()])
    sent = rows.sparkSession.sparkContext.broadcast((probes - centre) / scale)
    low, bins = -10 * STEPS, 16 * STEPS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = sent.value
        count, square = np.zeros(len(z) * bins), np.zeros(len(z) * bins)
        for batch in batches:
            x = (_matrix(batch, "v") - centre) / scale if batch.num_rows else np.empty((0, len(centre)))
            for i in range(0, len(x), 4096):
                part = x[i : i + 4096]
                far = np.maximum((part * part).sum(axis=1)[:, None] - 2 * part @ z.T + (z * z).sum(axis=1), 1e-12)
                at = np.clip(np.ceil(np.log2(far) * (STEPS / 2)) - low, 0, bins - 1).astype(np.int64) + np.arange(len(z)) * bins
                count += np.bincount(at.ravel(), minlength=len(count))
                square += np.bincount(at.ravel(), far.ravel(), minlength=len(count))
        yield _sums(np.arange(len(z)), np.concatenate([count.reshape(len(z), bins), square.reshape(len(z), bins)], axis=1))

    found = []
    for a in _summed(rows.select("v").mapInArrow(measure, SUMS)).values():
        within, square = np.cumsum(a[:bins]), np.cumsum(a[bins:])
        at = np.flatnonzero((within[:-STEPS] >= rules.min_members) & (within[STEPS:] <= 0.9 * n))
        if len(at):
            grows = within[at + STEPS] / within[at]
            best = at[np.argmin(grows)]
            if grows.min() <= 1.25:
                found.append(square[best] / (2 * within[best]))
    sent.unpersist()
    return max(float(np.sqrt(np.median(found))), LEAST_RADIUS) if found else 0.25


def _cells(rows: DataFrame, m: Mixture, width: float) -> DataFrame:
    """(w, z): number of rows and mean of their standardised features in each occupied cell, in the order of the first component."""
    size = len(m.centre)
    z = F.zip_with(F.zip_with(F.col("v"), F.lit(m.centre.tolist()), lambda a, b: a - b), F.lit(m.scale.tolist()), lambda a, b: a / b)
    zs = rows.select(z.alias("z")).select(*(F.get("z", F.lit(k)).alias(f"z{k}") for k in range(size)))
    key = F.array(*(F.round(F.col(f"z{k}") / width).cast("int") for k in range(size)))
    sums = zs.groupBy(key.alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("w"), *(F.avg(f"z{k}").alias(f"z{k}") for k in range(size)))
    lead = sum((F.col(f"z{k}") * float(p) for k, p in enumerate(m.project[:, 0])), F.lit(0.0))
    return sums.select("w", F.array(*(f"z{k}" for k in range(size))).alias("z"), lead.alias("lead")).repartitionByRange("lead", F.xxhash64("z")).select("w", "z")


def _em_pass(cells: DataFrame, m: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(mass, first and second moments of each component, noise mass, log-likelihood) under ``m``."""
    model = cells.sparkSession.sparkContext.broadcast(m)
    k, d = len(m.weight), m.project.shape[1]
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = model.value
        ready = mix.prepared()
        sums: dict[int, np.ndarray] = {-1: np.zeros(2)}
        for batch in batches:
            if not batch.num_rows:
                continue
            w, x = _column(batch, "w"), _matrix(batch, "z") @ mix.project
            for rows, near, r, log in mix.shares(x, ready):
                r *= w[rows, None]
                sums[-1] += [r[:, -1].sum(), (w[rows] * log).sum()]
                for i, j in enumerate(near):
                    at = np.flatnonzero(r[:, i] > 1e-9)
                    if len(at):
                        rj, xj = r[at, i], x[rows[at]]
                        got = np.concatenate([[rj.sum()], rj @ xj, ((xj * rj[:, None]).T @ xj)[upper]])
                        sums[j] = sums[j] + got if j in sums else got
        yield _sums(list(sums), list(sums.values()))

    sums = _summed(cells.mapInArrow(run, SUMS))
    model.unpersist()
    mass, one, two = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for j, a in sums.items():
        if j >= 0:
            mass[j], one[j] = a[0], a[1 : d + 1]
            two[j][upper] = a[d + 1 :]
            two[j] += np.triu(two[j], 1).T
    tail = sums.get(-1, np.zeros(2))
    return mass, one, two, float(tail[0]), float(tail[1])


def _parameters(mass: np.ndarray, d: int) -> np.ndarray:
    """Free parameters of each component: weight and mean, and of its covariance the part that is not drawn from the pool."""
    return 1 + d + mass / (mass + d * d) * d * (d + 1) / 2


def _maximised(m: Mixture, mass: np.ndarray, one: np.ndarray, two: np.ndarray, noise: float, radius: float, rules: MixtureRules) -> Mixture:
    """New parameters; each covariance is drawn towards the pooled one and has the floor added. Components that are too small, or
    that gain less over the noise than the criterion asks for their parameters, are dropped."""
    d = m.project.shape[1]
    keep = mass >= rules.min_members - 0.5
    mass, one, two = mass[keep], one[keep], two[keep]
    total = max(mass.sum() + noise, 1.0)
    mean = one / mass[:, None]
    scatter = two - mass[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(axis=0) / max(mass.sum(), 1.0)
    cov = (scatter + d * pooled) / (mass + d)[:, None, None] + (rules.floor * radius) ** 2 * np.eye(d)
    cov = (cov + cov.transpose(0, 2, 1)) / 2
    if len(mass):
        log_density = -0.5 * (np.linalg.slogdet(cov)[1] + d * np.log(2 * np.pi))
        fit = mass * (np.log(mass / total) + log_density) - 0.5 * np.trace(np.linalg.solve(cov, scatter), axis1=1, axis2=2)
        gain = fit - mass * (np.log(max(noise / total, 1.0 / total)) + m.log_noise)
        pays = 2 * gain > _parameters(mass, d) * np.log(max(total, 2))
        mass, mean, cov = mass[pays], mean[pays], cov[pays]
    return m.copy(weight=mass / total, mean=mean, cov=cov, noise=max(1 - mass.sum() / total, 1e-9))


def _merged(m: Mixture, radius: float, rules: MixtureRules) -> Mixture:
    """Components whose means are not apart become one."""
    k, d = m.mean.shape
    root = np.arange(k)
    side = np.sqrt(np.linalg.eigvalsh(m.cov)[:, -1]) if k else np.empty(0)

    def head(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    for i in range(k):
        off = m.mean[i + 1 :] - m.mean[i]
        gap = np.sqrt((off * off).sum(axis=1))
        for j in np.flatnonzero(gap < np.maximum(rules.apart * radius, rules.overlap * (side[i] + side[i + 1 :]))):
            u = off[j] / max(gap[j], 1e-12)
            spread = np.sqrt(u @ m.cov[i] @ u) + np.sqrt(u @ m.cov[i + 1 + j] @ u)
            if gap[j] < max(rules.apart * radius, rules.overlap * spread):
                a, b = head(i), head(i + 1 + j)
                root[max(a, b)] = min(a, b)
    heads, at = np.unique([head(j) for j in range(k)], return_inverse=True)
    if len(heads) == k:
        return m
    weight = np.bincount(at, m.weight)
    share = m.weight / weight[at]
    mean, cov = np.zeros((len(heads), d)), np.zeros((len(heads), d, d))
    np.add.at(mean, at, share[:, None] * m.mean)
    off = m.mean - mean[at]
    np.add.at(cov, at, share[:, None, None] * (m.cov + off[:, :, None] * off[:, None, :]))
    return m.copy(weight=weight, mean=mean, cov=cov)


def _settled(cells: DataFrame, m: Mixture, n: int, radius: float, rules: MixtureRules) -> tuple[Mixture, float]:
    """``m`` after expectation-maximisation until the likelihood settles, and its criterion; less is better."""
    last = -np.inf
    while True:
        *sums, log = _em_pass(cells, m)
        if log - last < rules.settle * n:
            if len((joined := _merged(m, radius, rules)).weight) == len(m.weight):
                return m, -2 * log + _parameters(m.weight * n, m.project.shape[1]).sum() * np.log(max(n, 2))
            m, last = joined, -np.inf
            continue
        better = _maximised(m, *sums, radius, rules)
        last = log if len(better.weight) == len(m.weight) else -np.inf
        m = better


def _left_over(cells: DataFrame, m: Mixture) -> DataFrame:
    """(w, z) of the cells in which the noise holds mass, and how much."""
    model = cells.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = model.value
        ready = mix.prepared()
        for batch in batches:
            if batch.num_rows:
                left, z = _column(batch, "w").copy(), _matrix(batch, "z")
                for rows, _, r, _ in mix.shares(z @ mix.project, ready):
                    left[rows] *= r[:, -1]
                yield pa.RecordBatch.from_arrays([pa.array(left[left > 0.5]), _lists(z[left > 0.5])], names=["w", "z"])

    return durable(cells.mapInArrow(run, "w double, z array<double>"))


def _places(left: DataFrame, width: float, turn: int, least: float) -> DataFrame:
    """(mass, z) of the places where ``left`` may hold a group: coarse cells of four shifted grids that hold at least ``least``, with
    their heaviest fine cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, w = _matrix(batch, "z"), _column(batch, "w")
            for g in range(4):
                at = np.floor(z / width + np.random.default_rng([turn, g]).random(z.shape[1])).astype(np.int32)
                # The cells of a batch are added up before they go on.
                cell, of = np.unique(at, axis=0, return_inverse=True)
                heaviest = np.zeros(len(cell), dtype=np.int64)
                order = np.lexsort((*z.T[::-1], w))
                heaviest[of.ravel()[order]] = order
                names = pa.array([bytes([g]) + c.tobytes() for c in cell], type=pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(of.ravel(), w, minlength=len(cell))), pa.array(w[heaviest]), _lists(z[heaviest])], names=["cell", "mass", "top", "z"])

    coarse = left.mapInArrow(run, "cell binary, mass double, top double, z array<double>").groupBy("cell").agg(F.sum("mass").alias("mass"), F.max_by("z", F.struct("top", "z")).alias("z"))
    return coarse.where(F.col("mass") >= least).groupBy("z").agg(F.max("mass").alias("mass"))


def _company(left: DataFrame, m: Mixture, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(mass, mean) of ``left`` within ``reach`` of each of the places ``x``."""
    sent = left.sparkSession.sparkContext.broadcast((x, m.project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, project = sent.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            w, y = _column(batch, "w"), _matrix(batch, "z") @ project
            for rows in _boxes(y):
                part = y[rows]
                gap = np.maximum(np.maximum(part.min(axis=0) - at, at - part.max(axis=0)), 0)
                for j in np.flatnonzero((gap * gap).sum(axis=1) <= reach * reach):
                    near = ((part - at[j]) ** 2).sum(axis=1) <= reach * reach
                    if near.any():
                        wj = w[rows[near]]
                        got = np.concatenate([[wj.sum()], wj @ part[near]])
                        sums[j] = sums[j] + got if j in sums else got
        yield _sums(list(sums), list(sums.values()))

    mass, mean = np.zeros(len(x)), x.copy()
    for j, a in _summed(left.mapInArrow(run, SUMS)).items():
        mass[j], mean[j] = a[0], a[1:] / a[0]
    sent.unpersist()
    return mass, mean


def _seeded(cells: DataFrame, m: Mixture, n: int, turn: int, radius: float, rules: MixtureRules) -> Mixture:
    """``m`` with a component for each place apart from the others at which the noise holds a group."""
    d, apart = m.project.shape[1], rules.apart * radius
    left = _left_over(cells, m)
    places = durable(_places(left, 2 * apart, turn, min(2.0, 0.8 * rules.min_members)))
    rest = places
    while True:
        page = rest.orderBy(F.desc("mass"), "z").limit(rules.candidates).select("mass", "z").toPandas()
        if not len(page):
            return m
        mass, x = _company(left, m, np.array(page["z"].tolist()) @ m.project, apart / 2)
        taken = mass < 0.8 * rules.min_members
        for mean in m.mean:
            taken |= ((x - mean) ** 2).sum(axis=1) <= (apart / 2) ** 2
        seeds = []
        for i in np.argsort(-mass, kind="stable"):
            if not taken[i]:
                seeds.append(i)
                taken |= ((x - x[i]) ** 2).sum(axis=1) < apart**2
        if seeds:
            break
        last, z = float(page["mass"].iloc[-1]), F.lit([float(v) for v in page["z"].iloc[-1]])
        rest = places.where((F.col("mass") < last) | ((F.col("mass") == last) & (F.col("z") > z)))
    share = mass[seeds] / max(n, 1)
    share *= min(1.0, 0.5 * m.noise / share.sum())
    narrow = np.tile(np.eye(d) * (rules.floor * radius) ** 2 * 2, (len(seeds), 1, 1))
    return m.copy(weight=np.append(m.weight, share), mean=np.concatenate([m.mean, x[seeds]]), cov=np.concatenate([m.cov, narrow]), noise=max(m.noise - share.sum(), 1e-9))


def _cut(m: Mixture, radius: float, rules: MixtureRules) -> Mixture:
    """``m`` with components that are too wide cut in two."""
    weight, mean, cov = [], [], []
    for w, mu, s in zip(m.weight, m.mean, m.cov):
        value, vector = np.linalg.eigh(s)
        if np.sqrt(value[-1]) > max(2.5 * rules.floor, rules.apart / 4) * radius:
            step = np.sqrt(value[-1]) * vector[:, -1]
            less = s - 0.9 * value[-1] * np.outer(vector[:, -1], vector[:, -1])
            weight, mean, cov = [*weight, w / 2, w / 2], [*mean, mu + step, mu - step], [*cov, less, less]
        else:
            weight, mean, cov = [*weight, w], [*mean, mu], [*cov, s]
    d = m.project.shape[1]
    return m.copy(weight=np.array(weight), mean=np.array(mean).reshape(-1, d), cov=np.array(cov).reshape(-1, d, d))


def _fitted(rows: DataFrame, m: Mixture, n: int, radius: float, rules: MixtureRules) -> Mixture:
    """The mixture with the number of components of the least criterion among the rounds."""
    cells = durable(_cells(rows, m, rules.cell * radius))
    best, least, turn = m, -2 * n * m.log_noise, 0
    while True:
        for trial in (lambda: _seeded(cells, best, n, turn, radius, rules), lambda: _cut(best, radius, rules)):
            grown = trial()
            if len(grown.weight) > rules.most_components:
                raise RuntimeError(f"more than {rules.most_components} clusters: divide the data first or raise most_components")
            if len(grown.weight) > len(best.weight):
                grown, score = _settled(cells, grown, n, radius, rules)
                if score < least:
                    best, least, turn = grown, score, turn + 1
                    break
        else:
            return best


def _middle_radius(rows: DataFrame, m: Mixture) -> float:
    """The radius of the component that the middle row of all clustered rows lies in, from all rows; 0 without components."""
    model = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = model.value
        ready, k = mix.prepared(), len(mix.weight)
        sums = np.zeros((k, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (_matrix(batch, "v") - mix.centre) / mix.scale @ mix.project
            for at, near, joint in mix.log_joint(x, ready):
                best = joint.argmax(axis=1)
                mine = best < len(near)
                own = near[best[mine]]
                far = ((x[at[mine]] - mix.mean[own]) ** 2).sum(axis=1)
                sums += np.stack([np.bincount(own, minlength=k), np.bincount(own, far, minlength=k)], axis=1)
        met = np.flatnonzero(sums[:, 0])
        yield _sums(met, sums[met])

    sums = np.array(list(_summed(rows.select("v").mapInArrow(run, SUMS)).values())).reshape(-1, 2)
    if not len(sums):
        return 0.0
    radius = np.sqrt(sums[:, 1] / sums[:, 0])
    order = np.argsort(radius)
    return float(radius[order][np.searchsorted(np.cumsum(sums[order, 0]), sums[:, 0].sum() / 2)])


def fit_mixture(rows: DataFrame, lengths: Sequence[int], rules: MixtureRules = MixtureRules()) -> Mixture:
    """The mixture of ``rows`` (key, v), fitted at the radius that its own components have."""
    centre, scale, value, vector, n = _standard(rows, lengths)
    if not n:
        return _reduced(centre, scale, value, vector, 1.0, rules)
    radius = rules.radius or _first_radius(rows, centre, scale, n, rules)
    tried: list[float] = []
    while True:
        m = _fitted(rows, _reduced(centre, scale, value, vector, radius, rules), n, radius, rules)
        seen = max(_middle_radius(rows, m), LEAST_RADIUS) if len(m.weight) else radius
        tried.append(radius)
        if any(2 / 3 <= seen / r <= 1.5 for r in tried):
            return m
        radius = seen


def assigned(rows: DataFrame, m: Mixture) -> DataFrame:
    """(key, component, density): the most probable component of each row and the row's log density there; noise is left out."""
    model = rows.sparkSession.sparkContext.broadcast(m)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = model.value
        ready = mix.prepared()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (_matrix(batch, "v") - mix.centre) / mix.scale @ mix.project
            k, top = np.full(len(x), -1, dtype=np.int32), np.zeros(len(x))
            for at, near, joint in mix.log_joint(x, ready):
                best = joint.argmax(axis=1)
                k[at], top[at] = np.append(near, -1)[best], joint[np.arange(len(at)), best]
            keep = pa.array(k >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), pa.array(k), pa.array(top)], names=["key", "component", "density"]).filter(keep)

    return rows.mapInArrow(run, f"key {kind}, component int, density double")


class Clusters:
    """Clusters of ``df`` by the numeric arrays ``arrays`` (column, length)."""

    def __init__(self, df: DataFrame, key: str, arrays: Sequence[tuple[str, int]], rules: MixtureRules = MixtureRules()):
        self.key, self.rules = key, rules
        rows = durable(complete_vectors(df, key, arrays))
        self.mixture = fit_mixture(rows, [n for _, n in arrays], rules)
        self.rows = assigned(rows, self.mixture)
        # At most most_components rows.
        self.sizes = self.rows.groupBy("component").agg(F.min("key").alias("cluster_id"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= rules.min_members)

    def members(self) -> DataFrame:
        """(key, cluster_id): each record of a cluster; the id of a cluster is its least key. Loners have no row."""
        return self.rows.join(F.broadcast(self.sizes), "component").select(F.col("key").alias(self.key), F.col("cluster_id").cast("bigint").alias("cluster_id"))

    def described(self, typical: int = 5) -> DataFrame:
        """(cluster_id, size, typical): the size of each cluster and its keys of highest density, densest first."""

        def densest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = pd.DataFrame({"key": [], "component": [], "density": []})
            for pdf in batches:
                held = pd.concat([held, pdf]) if len(held) else pdf
                held = held.sort_values(["density", "key"], ascending=[False, True]).groupby("component").head(typical)
            yield held

        top = self.rows.mapInPandas(densest, self.rows.schema)  # each task hands on a few rows of each component
        order = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("density"), "key"))
        few = top.withColumn("at", order).where(F.col("at") <= typical).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("t"))
        return few.join(F.broadcast(self.sizes), "component").select("cluster_id", "size", F.transform("t", lambda x: x["key"]).alias("typical"))
