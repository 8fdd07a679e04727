"""Points near other points or inside regions.

Points become unit vectors and are partitioned by a k-d tree of splits over the three coordinates. Each place (a ball of its
own radius, or a region) is copied to every cell that it touches, so a cell is answered alone: a local k-d tree over the
cell's points answers the balls by chord length, a plane sweep along the longitude answers the regions by crossing parity.
The splits are fitted on a bounded sample (``SAMPLE_ROWS`` rows, chosen by hash); they decide only how even the cells are,
never the result. Cells that hold many points at one spot are salted: points take one of several copies, places all of them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
SAMPLE_ROWS = 8192
CELL_ROWS = 60_000
MAX_DEPTH = 12


class KdSplits:
    """A complete binary tree of axis splits: node i has children 2i + 1 and 2i + 2, the leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        inner = 2**depth - 1
        self.dim, self.cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        self.weight = np.zeros(2**depth)
        stack = [(0, np.arange(len(sample)))]
        while stack:
            node, rows = stack.pop()
            if node >= inner:
                self.weight[node - inner] = len(rows)
                continue
            if len(rows):
                part = sample[rows]
                d = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                self.dim[node], self.cut[node] = d, float(np.median(part[:, d]))
            left = sample[rows, self.dim[node]] <= self.cut[node]
            stack += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]

    def leaf(self, x: Column, y: Column, z: Column) -> Column:
        """The leaf of a point, as a built-in expression that walks the tree."""
        if not self.depth:
            return F.lit(0)
        dims = F.lit([int(d) for d in self.dim])
        cuts = F.lit([float(c) for c in self.cut])
        at = F.array(x, y, z)
        step = lambda n, _: F.when(F.get(at, F.get(dims, n)) <= F.get(cuts, n), 2 * n + 1).otherwise(2 * n + 2).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step) - (2**self.depth - 1)

    def touched(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf that the box of a row touches; the boxes go down the tree together."""
        rows, nodes = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for _ in range(self.depth):
            d, cut = self.dim[nodes], self.cut[nodes]
            left, right = low[rows, d] <= cut, high[rows, d] > cut
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        order = np.lexsort((nodes, rows))
        return rows[order], nodes[order] - (2**self.depth - 1)


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=-1)


def chord(radius_m: np.ndarray | float) -> np.ndarray | float:
    """The straight distance on the unit sphere of a great-circle distance in metres."""
    return 2 * np.sin(np.minimum(np.asarray(radius_m) / (2 * EARTH_RADIUS_M), np.pi / 2))


def great_circle_m(lon1, lat1, lon2, lat2):
    """Haversine distance in metres of numpy arrays in degrees."""
    a, b, c, d = map(np.radians, (lon1, lat1, lon2, lat2))
    h = np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


class KdTree:
    """A k-d tree over points, queried by balls."""

    LEAF = 256

    def __init__(self, xyz: np.ndarray):
        self.xyz, self.nodes = xyz, []
        if len(xyz):
            self._grow(np.arange(len(xyz)))

    def _grow(self, rows: np.ndarray) -> int:
        part = self.xyz[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        k = len(self.nodes)
        self.nodes.append((low, high, rows, -1, -1))
        d = int(np.argmax(high - low))
        if len(rows) > self.LEAF and high[d] > low[d]:
            half = len(rows) // 2
            order = np.argpartition(part[:, d], half)
            left = self._grow(rows[order[:half]])
            right = self._grow(rows[order[half:]])
            self.nodes[k] = (low, high, None, left, right)
        return k

    def ball(self, centre: np.ndarray, radius: float) -> np.ndarray:
        """The rows at most ``radius`` away."""
        out, stack = [], [0] if self.nodes else []
        while stack:
            low, high, rows, left, right = self.nodes[stack.pop()]
            gap = np.maximum(np.maximum(low - centre, centre - high), 0)
            if gap @ gap > radius * radius:
                continue
            if rows is None:
                stack += [left, right]
            else:
                diff = self.xyz[rows] - centre
                out.append(rows[(diff * diff).sum(axis=1) <= radius * radius])
        return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def polygons(boundary: str | None) -> list[list[np.ndarray]]:
    """The pieces of a GeoJSON Polygon or MultiPolygon, each a list of rings; nothing for a null or unreadable boundary."""
    try:
        g = json.loads(boundary) if boundary else {}
        g = g.get("geometry", g) if g.get("type") == "Feature" else g
        pieces = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}[g["type"]](g["coordinates"])
        return [[np.array([p[:2] for p in ring], dtype=float) for ring in piece if len(ring) >= 3] for piece in pieces if piece]
    except (ValueError, KeyError, TypeError, AttributeError, IndexError):
        return []


def swept(lon: np.ndarray, lat: np.ndarray, pieces: list[list[np.ndarray]]) -> np.ndarray:
    """Which points lie in a region: a sweep along the longitude, the points sorted by it.

    Each edge, taken in the order of its western end, meets one contiguous stretch of the sorted points and turns the parity of
    those below it. Holes are rings of the same piece; a point in any piece is inside.
    """
    inside = np.zeros(len(lon), dtype=bool)
    for rings in pieces:
        a = np.concatenate([r for r in rings]) if rings else np.empty((0, 2))
        b = np.concatenate([np.roll(r, -1, axis=0) for r in rings]) if rings else a
        swap = a[:, 0] > b[:, 0]
        west, east = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
        order = np.argsort(west[:, 0], kind="stable")
        west, east = west[order], east[order]
        first, last = np.searchsorted(lon, west[:, 0], "left"), np.searchsorted(lon, east[:, 0], "left")
        odd = np.zeros(len(lon), dtype=bool)
        for (x1, y1), (x2, y2), i, j in zip(west, east, first, last):
            if i < j:
                odd[i:j] ^= lat[i:j] < y1 + (lon[i:j] - x1) * (y2 - y1) / (x2 - x1)
        inside |= odd
    return inside


def _cosine_range(a: float, b: float) -> tuple[float, float]:
    """The range of the cosine over an interval in radians."""
    k = np.ceil(a / np.pi)
    turns = [np.cos(k * np.pi)] if k * np.pi <= b else []
    turns += [np.cos((k + 1) * np.pi)] if (k + 1) * np.pi <= b else []
    ends = [np.cos(a), np.cos(b), *turns]
    return min(ends), max(ends)


def _box_of(pieces: list[list[np.ndarray]]) -> tuple[list[float], list[float]] | None:
    """A box of unit vectors around all points of a longitude-latitude rectangle."""
    if not (rings := [r for piece in pieces for r in piece]):
        return None
    p = np.radians(np.concatenate(rings))
    (a, b), (c, d) = p.min(axis=0), p.max(axis=0)
    up = _cosine_range(b, d)
    low, high = [], []
    for r in (_cosine_range(a, c), _cosine_range(a - np.pi / 2, c - np.pi / 2)):
        prod = [u * v for u in up for v in r]
        low.append(min(prod) - 1e-12)
        high.append(max(prod) + 1e-12)
    z = _cosine_range(b - np.pi / 2, d - np.pi / 2)
    return [*low, z[0] - 1e-12], [*high, z[1] + 1e-12]


def points_at_places(
    points: DataFrame,
    keys: Sequence[str],
    lon: str,
    lat: str,
    stands: DataFrame | None = None,
    zones: DataFrame | None = None,
    place: str = "place_id",
    cell_rows: int = CELL_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(keys, place): one row for each zone that contains a point and each stand at most its radius away.

    ``stands`` holds (id, lon, lat, radius in metres), ``zones`` (id, GeoJSON boundary), by position; their further columns are
    ignored. Points with a null, NaN or infinite coordinate match nothing; points off the globe (latitude beyond 90 or longitude
    beyond 180 degrees) can only lie in a zone. Places with a null id, an unreadable boundary or a null or negative radius match
    nothing. A key with the same place twice comes out once. Repeated keys must carry the same coordinates to be told apart.
    """
    spark = points.sparkSession
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    pts = points.select(*keys, F.col(lon).cast("double").alias("__lon"), F.col(lat).cast("double").alias("__lat")).where(ok(F.col("__lon")) & ok(F.col("__lat")))
    x, y, z = unit_vector(F.col("__lon"), F.col("__lat"))
    # A bounded sample by hash: each task keeps its least sample_rows, the driver gets sample_rows.
    n = pts.count()
    sample = np.array(pts.select(x.alias("x"), y.alias("y"), z.alias("z"), F.xxhash64(*keys, "__lon", "__lat").alias("h")).orderBy("h").limit(sample_rows).drop("h").collect(), dtype=float).reshape(-1, 3)
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / cell_rows))))))
    tree = KdSplits(sample, depth)
    salts = np.maximum(1, np.ceil(tree.weight * n / max(1, len(sample)) / cell_rows / 1.5)).astype(int)
    salt_of = F.get(F.lit([int(s) for s in salts]), F.col("__leaf"))
    cells = pts.withColumn("__leaf", tree.leaf(x, y, z).cast("int")).withColumn("__salt", F.pmod(F.xxhash64(*keys), salt_of).cast("int"))

    copies = "__place string, __boundary string, __clon double, __clat double, __radius double, __leaf int"

    def copied(batches):
        for pdf in batches:
            pdf = pdf[pdf["p"].notna()].reset_index(drop=True)
            low, high = np.full((len(pdf), 3), np.inf), np.full((len(pdf), 3), -np.inf)
            ball = pdf["b"].isna().to_numpy()
            lon, lat, radius = (pdf[c].to_numpy(dtype=float) for c in ("x", "y", "r"))
            fair = ball & np.isfinite(lon) & np.isfinite(lat) & np.isfinite(radius) & (radius >= 0) & (np.abs(lat) <= 90) & (np.abs(lon) <= 180)
            c, r = _unit(lon[fair], lat[fair]), (chord(radius[fair]) + 1e-12)[:, None]
            low[fair], high[fair] = c - r, c + r
            for k in np.flatnonzero(~ball):
                if box := _box_of(polygons(pdf["b"][k])):
                    low[k], high[k] = box
            some = np.flatnonzero(np.isfinite(low[:, 0]))
            rows, leaf = tree.touched(low[some], high[some])
            out = pdf.iloc[some[rows]].reset_index(drop=True)
            out.columns = ["__place", "__boundary", "__clon", "__clat", "__radius"]
            yield out.assign(__leaf=leaf.astype(np.int32))

    places = None
    if zones is not None:
        a, b = zones.columns[:2]
        places = zones.select(F.col(a).cast("string").alias("p"), F.col(b).alias("b"), *(F.lit(None).cast("double").alias(k) for k in ("x", "y", "r")))
    if stands is not None:
        a, b, c, d = stands.columns[:4]
        more = stands.select(F.col(a).cast("string").alias("p"), F.lit(None).cast("string").alias("b"), *(F.col(k).cast("double").alias(m) for k, m in ((b, "x"), (c, "y"), (d, "r"))))
        places = more if places is None else places.unionByName(more)
    key_types = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    if places is None:
        return spark.createDataFrame([], f"{key_types}, `{place}` string")
    halo = places.mapInPandas(copied, copies).withColumn("__salt", F.explode(F.sequence(F.lit(0), salt_of - 1)))

    def answer(pts_pdf: pd.DataFrame, places_pdf: pd.DataFrame) -> pd.DataFrame:
        pts_pdf = pts_pdf.sort_values("__lon", kind="stable", ignore_index=True)
        lons, lats = pts_pdf["__lon"].to_numpy(), pts_pdf["__lat"].to_numpy()
        hits, names = [], []
        balls = places_pdf[places_pdf["__boundary"].isna()]
        if len(balls) and len(lons):
            on_globe = np.flatnonzero((np.abs(lats) <= 90) & (np.abs(lons) <= 180))
            kd = KdTree(_unit(lons[on_globe], lats[on_globe]))
            for name, clon, clat, radius in zip(balls["__place"], balls["__clon"], balls["__clat"], balls["__radius"]):
                near = on_globe[kd.ball(_unit(clon, clat), float(chord(radius)) + 1e-12)]
                near = near[great_circle_m(lons[near], lats[near], clon, clat) <= radius]
                hits.append(near)
                names += [name] * len(near)
        for name, boundary in places_pdf.loc[places_pdf["__boundary"].notna(), ["__place", "__boundary"]].itertuples(index=False):
            within = np.flatnonzero(swept(lons, lats, polygons(boundary))) if len(lons) else []
            hits.append(within)
            names += [name] * len(within)
        rows = np.concatenate(hits).astype(np.int64) if hits else np.empty(0, dtype=np.int64)
        out = pts_pdf.iloc[rows][list(keys)].reset_index(drop=True)
        out[place] = pd.Series(names, dtype=object)
        return out.drop_duplicates()

    by = ["__leaf", "__salt"]
    return cells.groupBy(*by).cogroup(halo.groupBy(*by)).applyInPandas(answer, f"{key_types}, `{place}` string")
