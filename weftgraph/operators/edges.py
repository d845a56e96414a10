"""Operators on edges ``src, dst`` and vertices ``v``. Edges are symmetric where ``both`` is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.random import MODULUS, hashed
from weftgraph.plans.lineage import Shelf, cut


def rebase(edges: DataFrame, by: int = 1) -> DataFrame:
    """Ids that count from ``by``, made to count from 0."""
    return edges.select((F.col("src") - by).alias("src"), (F.col("dst") - by).alias("dst"))


def degrees(both: DataFrame) -> DataFrame:
    """``v, degree``: the number of a vertex's edge slots."""
    return both.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def adjacency_lists(both: DataFrame) -> DataFrame:
    """``v, neighbors``: a vertex's neighbours in order. A row is as long as a vertex's degree; this is for dumps."""
    return both.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


def non_isolated(vertices: DataFrame, both: DataFrame) -> DataFrame:
    return vertices.join(both, vertices["v"] == both["src"], "left_semi")


def isolated(vertices: DataFrame, both: DataFrame) -> DataFrame:
    return vertices.join(both, vertices["v"] == both["src"], "left_anti")


def adjacent(pairs: DataFrame, both: DataFrame) -> DataFrame:
    """``a, b, adjacent``: whether each pair is an edge."""
    edge = both.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().withColumn("adjacent", F.lit(True))
    return pairs.join(edge, ["a", "b"], "left").select("a", "b", F.coalesce("adjacent", F.lit(False)).alias("adjacent"))


def duplicates(edges: DataFrame) -> DataFrame:
    """``src, dst, times`` of edges that are there more than once."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)


def high_degree(both: DataFrame, vertices: DataFrame, factor: float) -> DataFrame:
    """``v, degree`` where the degree is ``factor`` times the square root of the number of vertices, or more."""
    limit = vertices.agg(F.floor(factor * F.sqrt(F.count(F.lit(1)).cast("double"))).alias("limit"))
    return degrees(both).join(F.broadcast(limit)).where(F.col("degree") >= F.col("limit")).select("v", "degree")  # one row


def sample_neighbors(both: DataFrame, share: float, seed: int) -> DataFrame:
    """Each edge slot with probability ``share``, the same ones every time."""
    return both.where(hashed(F.col("src"), F.col("dst"), seed) < int(share * MODULUS))


def relink(edges: DataFrame, renamed: DataFrame) -> DataFrame:
    """Edges with ends replaced as ``renamed`` (``v, new``) says."""
    a = renamed.select(F.col("v").alias("a"), F.col("new").alias("new_a"))
    b = renamed.select(F.col("v").alias("b"), F.col("new").alias("new_b"))
    moved = edges.join(a, F.col("src") == F.col("a"), "left").join(b, F.col("dst") == F.col("b"), "left")
    return moved.select(F.coalesce("new_a", "src").alias("src"), F.coalesce("new_b", "dst").alias("dst"))


def remove(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def neighbor_messages(both: DataFrame, state: DataFrame) -> DataFrame:
    """``v, sender, label``: what each vertex hears of its neighbours' state (``v, label``)."""
    return both.join(state, both["src"] == state["v"]).select(F.col("dst").alias("v"), F.col("src").alias("sender"), "label")


def by_source(edges: DataFrame) -> DataFrame:
    """Edges in order of (src, dst) within ranges of src."""
    return edges.repartitionByRange("src").sortWithinPartitions("src", "dst")


def graph_size(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``n, m``: vertices, and edges without regard to direction or repeats."""
    once = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return vertices.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(once.agg(F.count(F.lit(1)).alias("m"))))  # one row each


def add_vertices(vertices: DataFrame, more: DataFrame) -> DataFrame:
    return vertices.select("v").union(more.select("v")).distinct()


def remove_vertices(edges: DataFrame, vertices: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices without those in ``gone`` and the edges that end there."""
    names = gone.select(F.col("v").alias("gone"))
    left = edges.join(names, F.col("src") == F.col("gone"), "left_anti").join(names, F.col("dst") == F.col("gone"), "left_anti")
    return left, vertices.join(names, F.col("v") == F.col("gone"), "left_anti")


def breadth_first(both: DataFrame, start: Column | int, most: int | None = None) -> DataFrame:
    """``v, distance`` of the vertices that ``start`` reaches, in ``most`` steps at most.

    What a front reaches and is not in it or in the front before is new, so the others that were reached are not read again.
    """
    both = cut(both)
    shelf = Shelf(both.sparkSession, "v long, distance long")
    found = shelf.add(both.select(F.col("src").alias("v")).where(F.col("v") == start).distinct().withColumn("distance", F.lit(0).cast("long")))
    step = 0
    while found and (most is None or step < most):
        step += 1
        near = both.join(shelf.last().select(F.col("v").alias("at")), F.col("src") == F.col("at"), "left_semi").select(F.col("dst").alias("v")).distinct()
        found = shelf.add(near.join(shelf.last(2), "v", "left_anti").withColumn("distance", F.lit(step).cast("long")))
    return shelf.taken()
