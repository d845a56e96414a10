"""Near-duplicate vectors by a pivot-permutation index.

Each distinct vector is described by its nearest reference points (pivots), nearest first; the first is its home. Every
pivot has a list of the vectors that name it. Two vectors are compared if they share a pivot: those of one home in its
list, others in the list of the least pivot they share. A list puts out no pairs: for each vector the number of
links, and one edge into its local component.

Pivots are a bounded sample of the vectors, thinned to be at least two linking angles apart: a dense cluster would
otherwise hold many, of which its members name different ones. So it has one or a few, and all its pairs are compared.
All vectors are indexed. Long lists are split into blocks, of which all pairs are searched, so that a hot list is
spread over tasks and loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.runtime import cut, read, ship
from weftgraph.plans.connectivity import Graph, component_labels
from weftgraph.plans.unionfind import min_labels

SIMILAR = 0.9
#: Pivots that a vector names.
NEAREST = 12
#: Pivots before thinning: about twice the square root of the number of vectors, within these bounds. They are held on the driver and
#: broadcast, 32 MB of 64 dimensions at most; a billion vectors have as many.
FEWEST_PIVOTS, MOST_PIVOTS = 32, 65536
#: Vectors of a block of a list.
BLOCK = 2048
#: Pairs that are looked at one by one at a time.
VERIFIED = 1 << 16
#: Cosines in single precision that are no farther from the threshold than this are taken again in double precision.
UNSURE = 1e-4
#: Vectors of a list that have another home in common, from which they are not compared there at all.
GUESTS = 64


def unit(vectors: Iterable) -> np.ndarray:
    """The vectors as rows of length 1, in double precision."""
    x = np.array(list(vectors), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _describe(pivots: dict[int, np.ndarray], threshold: float) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds to each vector the numbers of its nearest pivots. Those of another dimension than any pivot name one number
    that stands for the dimension.

    Of the NEAREST, those that are farther than the first by more than twice the linking angle are left out, and no pair is
    lost by that: the home of whatever links with a vector is no farther from it than that, so it is named before them, and
    the two meet there. So a vector close to its pivot is in few lists.
    """
    reach = 2 * math.acos(threshold) + 1e-6
    base, first = {}, 0
    for size in sorted(pivots):
        base[size] = first
        first += len(pivots[size])

    def describe(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len).to_numpy()
            named: list = [None] * len(batch)
            for size in set(sizes.tolist()):
                at = np.flatnonzero(sizes == size)
                if size not in pivots:
                    for i in at:
                        named[i] = [-size]
                    continue
                near = unit(batch["embedding"].iloc[at]) @ pivots[size].T
                k = min(NEAREST, near.shape[1])
                order = np.argsort(-near, axis=1, kind="stable")[:, :k]
                angle = np.arccos(np.clip(np.take_along_axis(near, order, axis=1), -1, 1))
                for i, numbers, within in zip(at, order + base[size], angle <= angle[:, :1] + reach):
                    named[i] = numbers[within].astype(np.int32)
            yield batch.assign(pivots=named)

    return describe


def _rectangular(rows: Iterable) -> np.ndarray:
    """Lists of numbers as rows of one length, filled up with a number above all pivots."""
    rows = list(rows)
    out = np.full((len(rows), max(map(len, rows))), np.iinfo(np.int64).max)
    for row, numbers in zip(out, rows):
        row[: len(numbers)] = numbers
    return out


def _met_before(pivot: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of pairs of rows of named pivots: whether a pivot less than ``pivot`` is in both."""
    return ((left[:, :, None] == right[:, None, :]) & (left[:, :, None] < pivot)).any(axis=(1, 2))


def _spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the pairs in ``hit`` that connect what all of them connect."""
    rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    i, j = np.r_[rows, hit[:, columns].argmax(axis=0)], np.r_[hit[rows].argmax(axis=1), columns]
    root = min_labels(i, len(hit) + j, sum(hit.shape))
    a, b = np.nonzero(hit & (root[: len(hit), None] != root[None, len(hit) :]))
    return np.r_[i, a], np.r_[j, b]


def _search(threshold: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def search(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        pivot, one, other = key
        members = members.sort_values(["rep", "k1", "k2"], kind="stable").reset_index(drop=True)
        n = members["n"].to_numpy(np.int64)
        raw = np.array(list(members["embedding"]), np.float64)
        raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])  # exact, and no square overflows
        length = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        short, named = (raw / length[:, None]).astype(np.float32), _rectangular(members["pivots"])
        home = named[:, 0]
        links = np.zeros(len(members), np.int64)
        ends: list[np.ndarray] = [np.empty((0, 2), np.int64)]

        def compare(left: np.ndarray, right: np.ndarray, same: bool) -> None:
            cosines = short[left] @ short[right].T
            hit = cosines >= threshold - UNSURE
            if same:
                hit = np.triu(hit, 1)
            if not hit.any():
                return

            def drop(some: np.ndarray, wrong: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
                a, b = np.nonzero(some)
                for k in range(0, len(a), VERIFIED):
                    i, j = a[k : k + VERIFIED], b[k : k + VERIFIED]
                    out = wrong(left[i], right[j])
                    hit[i[out], j[out]] = False

            drop(hit & (cosines < threshold + UNSURE), lambda i, j: np.einsum("ij,ij->i", raw[i], raw[j]) / (length[i] * length[j]) < threshold)
            at_home = home[left][:, None] == home[right]
            hit &= ~at_home | (home[left] == pivot)[:, None]
            drop(hit & ~at_home, lambda i, j: _met_before(pivot, named[i], named[j]))
            links[left] += hit @ n[right]
            links[right] += hit.T @ n[left]
            i, j = _spanning(hit)
            ends.append(np.stack([left[i], right[j]], axis=1))

        homes, guests = np.unique(home[home != pivot], return_counts=True)
        group = np.where(np.isin(home, homes[guests >= GUESTS]), home, pivot)
        side = (members["block"] == one).to_numpy()
        for a in np.unique(group):
            for b in np.unique(group):
                if (a == b and a != pivot) or (one == other and a > b):
                    continue
                left = np.flatnonzero(side & (group == a))
                right = np.flatnonzero((side if one == other else ~side) & (group == b))
                if len(left) and len(right):
                    compare(left, right, one == other and a == b)
        found = np.concatenate(ends)
        root = min_labels(found[:, 0], found[:, 1], len(members))
        some = np.flatnonzero(links)
        rep = members["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[some], "k1": members["k1"].to_numpy()[some], "k2": members["k2"].to_numpy()[some], "links": links[some], "root": rep[root[some]]})

    return search


def thinned(points: np.ndarray, closest: float) -> np.ndarray:
    """The points, in order, whose cosine to every one taken before is less than ``closest``."""
    out, taken = np.empty_like(points), 0
    for point in points:
        if not taken or (out[:taken] @ point).max() < closest:
            out[taken] = point
            taken += 1
    return out[:taken]


def fit_pivots(classes: DataFrame, number: int, threshold: float = SIMILAR) -> dict[int, np.ndarray]:
    """Reference points by dimension: the ``number`` vectors whose ids have the least hashes, so at most MOST_PIVOTS rows,
    without those that are less than twice the angle of ``threshold`` from another one."""
    rows = classes.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep", "k1").limit(number).collect()
    by: dict[int, list] = {}
    for row in rows:
        by.setdefault(len(row["embedding"]), []).append(row["embedding"])
    return {size: thinned(unit(vectors), 2 * threshold**2 - 1) for size, vectors in by.items()}


def _blocks(listed: DataFrame) -> list[tuple]:
    """``pivot, home, first, own, blocks`` of the lists of more than BLOCK vectors: the blocks of a home's vectors are the ``own``
    ones from ``first`` on, of ``blocks`` in the list. A null home stands for all that have no blocks to themselves."""
    sizes = cut(listed.groupBy("pivot", "home").count())
    totals = sizes.groupBy("pivot").agg(F.sum("count").alias("count")).where(F.col("count") > BLOCK).collect()  # of MOST_PIVOTS pivots at most, and of dimensions without one
    rest = {r["pivot"]: r["count"] for r in totals}
    hot: dict[int, list] = {}
    for r in sizes.where((F.col("count") > BLOCK) & (F.col("pivot") != F.col("home"))).orderBy("pivot", "home").collect():  # NEAREST / BLOCK of the vectors at most
        hot.setdefault(r["pivot"], []).append((r["home"], -(-r["count"] // BLOCK)))
        rest[r["pivot"]] -= r["count"]
    out = []
    for pivot, left in rest.items():
        first = own = max(1, -(-left // BLOCK))
        blocks = first + sum(k for _, k in hot.get(pivot, []))
        out.append((pivot, None, 0, own, blocks))
        for home, k in hot.get(pivot, []):
            out.append((pivot, home, first, k, blocks))
            first += k
    return out


def near_duplicate_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = SIMILAR) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors link if their cosine, in double precision, is ``threshold`` or more. Null, empty and zero vectors and those
    with null or non-finite entries link with nothing, nor do vectors of different dimensions or with a null id.
    Equal vectors are copies and link with each other; each row counts as a vector of its own in ``n_links``. Rows
    of equal id share a component. An empty table gives no rows. Other columns are neither read nor returned.

    All rows are indexed and looked up; a pair of which the vectors share none of their NEAREST pivots is not found. Recall
    against brute force, as the tests hold it: 0.99 of the links of 20,000 vectors, a third of them near copies of one, 0.98
    of those of groups of 2 to 7 among 5,000 others; 1.0 of both when measured.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    valid = F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0)
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    keyed = every.where(valid).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(7), "embedding")})

    # copies: one class for each distinct vector
    classes = cut(keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    one = keyed.join(classes.withColumnRenamed("rep", "vec_id"), ["k1", "k2", "vec_id"]).withColumnRenamed("vec_id", "rep").dropDuplicates(["rep", "k1", "k2"])
    number = min(MOST_PIVOTS, max(FEWEST_PIVOTS, 1 << round(math.log2(2 * math.sqrt(max(1, classes.count()))))))
    one = cut(one.select("rep", "k1", "k2", "n", "embedding"))
    pivots = fit_pivots(one, number, threshold)

    # the inverted lists
    kind = dict(one.dtypes)["embedding"]
    index = one.mapInPandas(_describe(pivots, threshold), f"rep long, k1 long, k2 long, n long, embedding {kind}, pivots array<int>")
    index = cut(index)
    listed = index.select("*", F.explode("pivots").alias("pivot")).withColumn("home", F.get("pivots", F.lit(0)))
    long_lists = _blocks(listed.select("pivot", "home"))
    if long_lists:
        layout = spark.createDataFrame(long_lists, "pivot int, of int, first int, own int, blocks int")
        common = layout.where(F.col("of").isNull()).select("pivot", F.struct("first", "own", "blocks").alias("common"))
        hot = layout.where(F.col("of").isNotNull()).select("pivot", F.col("of").alias("home"), F.struct("first", "own", "blocks").alias("hot"))
        listed = listed.join(F.broadcast(common), "pivot", "left").join(F.broadcast(hot), ["pivot", "home"], "left")
        at = F.coalesce("hot", "common", F.struct(F.lit(0).alias("first"), F.lit(1).alias("own"), F.lit(1).alias("blocks")))
        listed = listed.withColumn("at", at).withColumn("block", F.col("at.first") + F.pmod(F.xxhash64("rep", "k1"), F.col("at.own")).cast("int"))
        # vectors of one hot home are compared in its own list
        met = F.filter(F.sequence(F.lit(0), F.col("at.blocks") - 1), lambda k: F.col("hot").isNull() | (k < F.col("hot.first")) | (k >= F.col("hot.first") + F.col("hot.own")))
        listed = listed.withColumn("with", F.explode(met)).drop("common", "hot", "at")
    else:
        listed = listed.withColumns({"block": F.lit(0), "with": F.lit(0)})
    listed = listed.withColumns({"one": F.least("block", "with"), "other": F.greatest("block", "with")}).drop("home", "with")
    found = cut(listed.groupBy("pivot", "one", "other").applyInPandas(_search(threshold), "rep long, k1 long, k2 long, links long, root long"))

    links = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("src"), F.col("root").alias("dst")).where(F.col("src") != F.col("dst")).distinct()
    shared_id = keyed.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("rep").alias("src"), F.col("vec_id").alias("dst")).where(F.col("src") != F.col("dst")).distinct()
    labels = component_labels(Graph.of(edges.unionByName(shared_id)))
    counted = classes.join(links, ["k1", "k2"], "left").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of = labels.select(F.col("v").alias("of"), "label")
    ids = every.select("vec_id", F.when(valid, F.xxhash64("embedding")).alias("a"), F.when(valid, F.xxhash64(F.lit(7), "embedding")).alias("b"))
    out = ids.join(counted, (F.col("a") == F.col("k1")) & (F.col("b") == F.col("k2")), "left").join(of, F.col("vec_id") == F.col("of"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector; odd rows as in :func:`near_duplicate_vectors`."""
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
