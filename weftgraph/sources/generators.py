"""Generators of random graphs. Every number is a hash of ids and the seed, so a graph is the same on any cluster.

All give symmetric edges ``src, dst``, each once, without loops, and vertices 0 to n - 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.random import MODULUS, hashed, mixed
from weftgraph.plans.connectivity import Graph, symmetric
from weftgraph.plans.lineage import cut, ship


def _vertices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"))


def _unit(column: Column, salt: int, seed: int) -> Column:
    """A number in [0, 1)."""
    return mixed(column, salt, seed).cast("double") / MODULUS


def _undirected(pairs: DataFrame) -> DataFrame:
    once = pairs.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return symmetric(once)


#: Rows that are put in order in one task.
ORDERED = 1 << 16


def _cutoff(rows: DataFrame, key: str, m: int, high: int) -> int:
    """The ``m``-th least of the keys, which are different whole numbers from 0 to ``high`` - 1. Keys are counted in 1,024 ranges,
    then in as many of the range that holds it, until a range is short."""
    low = 0
    while high - low > ORDERED:
        width = -(-(high - low) // 1024)
        ranges = rows.where((F.col(key) >= low) & (F.col(key) < high)).groupBy(F.floor((F.col(key) - low) / width).cast("long").alias("range")).count()
        for r in sorted(ranges.collect(), key=lambda r: r["range"]):
            if m <= r["count"]:
                low, high = low + r["range"] * width, min(high, low + (r["range"] + 1) * width)
                break
            m -= r["count"]
    return rows.where((F.col(key) >= low) & (F.col(key) < high)).orderBy(key).offset(m - 1).first()[key]


def gnm(spark: SparkSession, n: int, m: int, seed: int = 1) -> Graph:
    """``m`` different edges: the first ones of a stream of random pairs, without loops and repeats."""
    m = min(m, n * (n - 1) // 2)
    drawn = int(1.2 * m) + 64
    while m:
        i = spark.range(drawn).select(F.col("id").alias("i"))
        pairs = i.select("i", (mixed(F.col("i"), 0, seed) % n).alias("a"), (mixed(F.col("i"), 1, seed) % n).alias("b")).where("a != b")
        once = cut(pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("i").alias("first")))
        if once.count() >= m:
            break
        drawn *= 2
    else:
        return Graph(spark.createDataFrame([], "src long, dst long"), _vertices(spark, n))
    kept = once.where(F.col("first") <= _cutoff(once, "first", m, drawn)).select("src", "dst")
    return Graph(symmetric(kept), _vertices(spark, n))


def grid_2d(spark: SparkSession, rows: int, columns: int, p: float = 1.0, periodic: bool = False, seed: int = 1) -> Graph:
    """A lattice; each edge is kept with probability ``p``. With ``periodic`` the borders are joined."""
    v = _vertices(spark, rows * columns).withColumn("x", F.col("v") % columns).withColumn("y", F.floor(F.col("v") / columns).cast("long"))
    right = v.where(F.lit(periodic) | (F.col("x") < columns - 1)).select(F.col("v").alias("src"), (F.col("y") * columns + (F.col("x") + 1) % columns).alias("dst"))
    down = v.where(F.lit(periodic) | (F.col("y") < rows - 1)).select(F.col("v").alias("src"), (((F.col("y") + 1) % rows) * columns + F.col("x")).alias("dst"))
    every = right.unionByName(down)
    kept = every if p >= 1 else every.where(hashed(F.least("src", "dst"), F.greatest("src", "dst"), seed) < int(p * MODULUS))
    return Graph(_undirected(kept), _vertices(spark, rows * columns))


def points(spark: SparkSession, n: int, dimensions: int, seed: int = 1) -> DataFrame:
    """``v, x0, x1[, x2]``: points on a lattice of 2^31 - 1 steps in the unit square or cube."""
    return _vertices(spark, n).withColumns({f"x{k}": _unit(F.col("v"), k, seed) for k in range(dimensions)})


def rgg(spark: SparkSession, n: int, r: float, dimensions: int = 2, seed: int = 1) -> Graph:
    """An edge where two points are at most ``r`` apart. Points meet in the cells of side r next to their own."""
    cells = [f"c{k}" for k in range(dimensions)]
    placed = points(spark, n, dimensions, seed)
    for k in range(dimensions):
        placed = placed.withColumn(f"c{k}", F.floor(F.col(f"x{k}") / r).cast("long"))
    offers = placed
    for c in cells:
        offers = offers.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    other = offers.select(F.col("v").alias("w"), *(F.col(f"x{k}").alias(f"y{k}") for k in range(dimensions)), *cells)
    square = sum(((F.col(f"x{k}") - F.col(f"y{k}")) * (F.col(f"x{k}") - F.col(f"y{k}")) for k in range(dimensions)), F.lit(0.0))
    near = placed.join(other, cells).where((F.col("v") < F.col("w")) & (square <= r * r))
    return Graph(symmetric(near.select(F.col("v").alias("src"), F.col("w").alias("dst"))), _vertices(spark, n))


#: Points of a band that meet in one sector, about; a sector of more is dealt out by salts.
MET = 4096


def rhg(spark: SparkSession, n: int, gamma: float = 2.8, degree: float = 8, seed: int = 1) -> Graph:
    """A random hyperbolic graph: an edge where two points of a disc are at most its radius apart.

    Points lie in bands of the radius. Between two bands only points within an angle that depends on the bands can be that
    near; they meet in sectors of that angle. An inner band reaches all around: its few points are repeated, so that the
    many of an outer band can be dealt out.
    """
    alpha = (gamma - 1) / 2
    xi = alpha / (alpha - 0.5) if alpha > 0.5 else 10.0
    radius = max(1.0, 2 * math.log(2 * n * xi * xi / (math.pi * degree)))
    spread = math.cosh(alpha * radius) - 1
    bands = max(1, int(radius / 2))
    low = [radius * k / bands for k in range(bands + 1)]
    placed = _vertices(spark, n).select("v", F.least(F.acosh(1 + _unit(F.col("v"), 1, seed) * spread) / alpha, F.lit(radius)).alias("r"), (_unit(F.col("v"), 2, seed) * (2 * math.pi)).alias("t"))
    placed = placed.withColumn("band", F.least(F.floor(F.col("r") / (radius / bands)), F.lit(bands - 1)).cast("int"))

    def reach(a: float, b: float) -> float:
        if a + b <= radius or a == 0 or b == 0:
            return math.pi
        c = (math.cosh(a) * math.cosh(b) - math.cosh(radius)) / (math.sinh(a) * math.sinh(b))
        return math.acos(max(-1.0, min(1.0, c)))

    expected = [n * (math.cosh(alpha * low[k + 1]) - math.cosh(alpha * low[k])) / spread for k in range(bands)]
    pairs = []
    for a in range(bands):
        for b in range(a, bands):
            sectors = max(1, int(2 * math.pi / max(reach(low[a], low[b]), 1e-9)))
            pairs.append((a, b, sectors, max(1, math.ceil(expected[b] / sectors / MET))))
    plan = F.broadcast(spark.createDataFrame(pairs, "band_a int, band_b int, sectors long, salts long"))  # bands squared, some hundred rows
    sector = lambda t: F.least(F.floor(F.col(t) / (2 * math.pi) * F.col("sectors")).cast("long"), F.col("sectors") - 1)
    a = placed.select(F.col("v").alias("va"), F.col("r").alias("ra"), F.col("t").alias("ta"), F.col("band").alias("band_a")).join(plan, "band_a").withColumn("here", sector("ta"))
    b = placed.select(F.col("v").alias("vb"), F.col("r").alias("rb"), F.col("t").alias("tb"), F.col("band").alias("band_b")).join(plan, "band_b").withColumn("at", sector("tb"))
    near = F.array_distinct(F.array(*(F.pmod(F.col("here") + d, F.col("sectors")) for d in (-1, 0, 1))))
    a = a.withColumn("at", F.explode(near)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("va", "ra", "ta", "band_a", "band_b", "at", "salt")
    b = b.withColumn("salt", F.pmod(mixed(F.col("vb"), 3, seed), F.col("salts")))
    met = a.join(b, ["band_a", "band_b", "at", "salt"]).where((F.col("band_a") != F.col("band_b")) & (F.col("va") != F.col("vb")) | (F.col("va") < F.col("vb")))
    cosine = F.cosh("ra") * F.cosh("rb") - F.sinh("ra") * F.sinh("rb") * F.cos(F.col("ta") - F.col("tb"))
    found = met.where(cosine <= math.cosh(radius)).select(F.col("va").alias("src"), F.col("vb").alias("dst"))
    return Graph(_undirected(found), _vertices(spark, n))


def ba(spark: SparkSession, n: int, d: int, seed: int = 1) -> Graph:
    """Preferential attachment: each vertex has ``d`` edges to earlier ones, copied from a random earlier end of an edge.

    The end of edge slot e is that of the slot which a hash of e chooses among those before; even slots are their own
    vertex. So each edge is found by itself, in a chain of hashes, without the others.
    """
    ship(spark)
    edges = spark.range(n * d).select(F.col("id").alias("e")).mapInPandas(_ba_ends(d, seed), "src long, dst long")
    return Graph(_undirected(edges), _vertices(spark, n))


def _ba_ends(d: int, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            e = batch["e"].to_numpy(np.int64)
            slot = 2 * e + 1
            odd = np.arange(len(e))
            while len(odd):
                x = slot[odd].astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
                slot[odd] = (x % slot[odd].astype(np.uint64)).astype(np.int64)
                odd = odd[slot[odd] % 2 == 1]
            yield pd.DataFrame({"src": e // d, "dst": slot // 2 // d})

    return ends


def rdg(spark: SparkSession, n: int, dimensions: int = 2, seed: int = 1, cell: int | None = None) -> Graph:
    """The Delaunay graph of random points in the unit square or cube: cells of about ``cell`` points are triangulated with a
    halo of the cells around them, and each cell keeps the edges of its own points.

    The graph of a cell is exact as long as no empty circle (sphere) reaches beyond its halo, which for uniform points fails
    with a probability that falls exponentially in ``cell``; only along the border of the square may flat ones reach farther.
    """
    ship(spark)
    cell = cell or {2: 512, 3: 64}[dimensions]
    side = max(1, int((n / cell) ** (1 / dimensions)))
    cells, axes = [f"c{k}" for k in range(dimensions)], [f"x{k}" for k in range(dimensions)]
    placed = points(spark, n, dimensions, seed).withColumns({c: F.least(F.floor(F.col(x) * side), F.lit(side - 1)).cast("int") for c, x in zip(cells, axes)})
    offers = placed.withColumn("own", F.struct(*cells))
    for c in cells:
        offers = offers.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1))))).where(F.col(c).between(0, side - 1))
    offers = offers.select(*cells, "v", *axes, (F.col("own") == F.struct(*cells)).alias("inside"))
    edges = offers.groupBy(*cells).applyInPandas(_triangulate, "src long, dst long")  # a group has about cell * 3^dimensions points
    return Graph(_undirected(edges), _vertices(spark, n))


def _balls(points: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Centre and squared radius of the circle or sphere through each simplex's corners."""
    first, rest = points[corners[:, 0]], points[corners[:, 1:]]
    away = rest - first[:, None]
    half = (away**2).sum(axis=2) / 2
    flat = np.abs(np.linalg.det(away)) < 1e-300
    away[flat] = np.eye(points.shape[1])
    centre = np.linalg.solve(away, half[:, :, None])[:, :, 0]
    centre[flat] = np.inf
    return np.column_stack([first + centre, (centre**2).sum(axis=1)])


def _triangulate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of the Delaunay triangulation that have an end inside: points are inserted one by one, and the simplices whose
    balls hold the new point are replaced by a fan around it."""
    axes = [c for c in pdf.columns if c.startswith("x")]
    pdf = pdf.drop_duplicates(axes).sort_values("v")
    xy = pdf[axes].to_numpy(float)
    ids, inside = pdf["v"].to_numpy(np.int64), pdf["inside"].to_numpy(bool)
    n, d = xy.shape
    # one simplex around all: its corners lie far out on the axes and opposite to them
    pts = np.vstack([xy, np.full((1, d), -1e3), np.eye(d) * 1e3 * 2 * d - 1e3])
    corners, balls = np.empty((4 * n + 64, d + 1), np.int64), np.empty((4 * n + 64, d + 1))
    alive = np.zeros(len(corners), bool)
    corners[0], alive[0], used = np.arange(n, n + d + 1), True, 1
    balls[:1] = _balls(pts, corners[:1])
    facets = [[j for j in range(d + 1) if j != i] for i in range(d + 1)]
    for i in np.argsort(xy[:, 0], kind="stable"):
        live = np.flatnonzero(alive[:used])
        bad = live[((balls[live, :d] - pts[i]) ** 2).sum(1) < balls[live, d]]
        sides = np.concatenate([corners[bad][:, f] for f in facets])
        _, first, times = np.unique(np.sort(sides, axis=1), axis=0, return_index=True, return_counts=True)
        rim = sides[first[times == 1]]
        alive[bad] = False
        fan = np.column_stack([rim, np.full(len(rim), i)])
        if used + len(fan) > len(corners):
            keep = np.flatnonzero(alive[:used])
            room = max(len(corners), 2 * (len(keep) + len(fan)))
            corners, balls = (np.concatenate([x[keep], np.empty((room - len(keep), d + 1), x.dtype)]) for x in (corners, balls))
            alive, used = np.arange(room) < len(keep), len(keep)
        corners[used : used + len(fan)], balls[used : used + len(fan)] = fan, _balls(pts, fan)
        alive[used : used + len(fan)] = True
        used += len(fan)
    simplices = corners[:used][alive[:used]]
    pairs = np.concatenate([simplices[:, [a, b]] for a in range(d + 1) for b in range(a)])
    pairs = np.unique(np.sort(pairs[(pairs < n).all(1)], axis=1), axis=0)
    pairs = pairs[inside[pairs].any(1)] if len(pairs) else pairs
    return pd.DataFrame({"src": ids[pairs[:, 0]], "dst": ids[pairs[:, 1]]})


GENERATORS = {
    "gnm_undirected": lambda spark, c: gnm(spark, c.n, c.m, c.seed),
    "rdg_2d": lambda spark, c: rdg(spark, c.n, 2, c.seed),
    "rdg_3d": lambda spark, c: rdg(spark, c.n, 3, c.seed),
    "rgg_2d": lambda spark, c: rgg(spark, c.n, c.r, 2, c.seed),
    "rgg_3d": lambda spark, c: rgg(spark, c.n, c.r, 3, c.seed),
    "rhg": lambda spark, c: rhg(spark, c.n, c.gamma, c.d, c.seed),
    "ba": lambda spark, c: ba(spark, c.n, c.d, c.seed),
    "grid_2d": lambda spark, c: grid_2d(spark, c.n, c.m, c.p, c.periodic, c.seed),
}
