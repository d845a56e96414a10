"""The connected sets of an undirected graph: several strategies with one result.

Every strategy returns ``v, label``, one row for each vertex, where the label is the least vertex of the component; a
vertex without edges is its own label. ``edges`` has ``src, dst`` in either direction, with loops and repeats allowed.

The default strategy first replaces each partition's edges by a spanning forest. Up to ``base`` edges are then solved in
one task on an executor; more are contracted, cluster by cluster, in distributed rounds until they are few enough.
Nothing is collected to the driver but counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.random import start_time, uniform_below
from weftgraph.plans.lineage import Shelf, cut, ship
from weftgraph.plans.unionfind import forest_of_partition, label_all

#: Edges that one task solves: about 250 MB in numpy and 6 seconds (5 million took 620 MB and 15 seconds).
BASE_EDGES = 2_000_000
#: Steps of the first window in which clusters grow by rounds, times their mean starting time.
WINDOW = 2
EDGE = "src long, dst long"
LABEL = "v long, label long"


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


def cover(labels: DataFrame, vertices: DataFrame) -> DataFrame:
    """Labels for all vertices: those without one are their own."""
    known = labels.select(F.col("v").alias("known"), "label")
    return vertices.select("v").distinct().join(known, F.col("v") == F.col("known"), "left").select("v", F.coalesce("label", "v").alias("label"))


def local_forest(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same connected sets: the forest of each partition. Loops are dropped."""
    ship(edges.sparkSession)
    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInPandas(forest_of_partition, EDGE)


def in_one_task(edges: DataFrame) -> DataFrame:
    """Labels of the edges' vertices, solved by one task on an executor."""
    ship(edges.sparkSession)
    return edges.select("src", "dst").repartition(1).mapInPandas(label_all, LABEL)


def sequential(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Gathered in one task. Each partition sends its spanning forest, and the task folds them as they come, so that it
    holds in proportion to the vertices, not to the edges. For graphs whose vertices fit there."""
    return cover(in_one_task(local_forest(edges)), vertices)


def canonical(raw: DataFrame) -> DataFrame:
    """``v, label`` with any labels: each replaced by the least vertex that bears it."""
    least = raw.groupBy(F.col("label").alias("raw")).agg(F.min("v").alias("least"))
    return raw.join(least, F.col("label") == F.col("raw")).select("v", F.col("least").alias("label"))


# --- label propagation ---------------------------------------------------------------------------------------------


def min_label_step(state: DataFrame, both: DataFrame) -> DataFrame:
    """Each vertex takes the least label among its own and its neighbours'; ``both`` are symmetric edges."""
    heard = both.join(state, both["src"] == state["v"]).groupBy("dst").agg(F.min("label").alias("heard"))
    return state.join(heard, state["v"] == heard["dst"], "left").select("v", F.least("label", F.coalesce("heard", "label")).alias("label"))


def pointer_jump_step(state: DataFrame) -> DataFrame:
    """Each vertex takes the label of its label."""
    root = state.select(F.col("v").alias("at"), F.col("label").alias("root"))
    return state.join(root, state["label"] == root["at"], "left").select("v", F.least("label", F.coalesce("root", "label")).alias("label"))


def push_to_old_root(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where a vertex has left its label, the vertex of that label hears of the new one."""
    old = before.select("v", F.col("label").alias("old"))
    pushed = after.join(old, "v").where(F.col("label") < F.col("old")).groupBy(F.col("old").alias("at")).agg(F.min("label").alias("pushed"))
    return after.join(pushed, after["v"] == pushed["at"], "left").select("v", F.least("label", F.coalesce("pushed", "label")).alias("label"))


def _spread(state: DataFrame, both: DataFrame) -> DataFrame:
    """One round of :func:`min_label_step` in which only what ``changed`` in the round before is told."""
    told = state.where("changed").select(F.col("v").alias("from"), F.col("label").alias("told"))
    heard = both.join(told, both["src"] == F.col("from")).groupBy("dst").agg(F.min("told").alias("heard"))
    better = F.coalesce(F.col("heard") < F.col("label"), F.lit(False))
    return state.join(heard, state["v"] == heard["dst"], "left").select("v", F.when(better, F.col("heard")).otherwise(F.col("label")).alias("label"), better.alias("changed"))


def label_propagation(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The least label spreads by one edge a round; as many rounds as the longest shortest path."""
    both = cut(symmetric(edges).distinct())
    state = endpoints(edges).select("v", F.col("v").alias("label"), F.lit(True).alias("changed"))
    while not (state := cut(_spread(state, both))).where("changed").isEmpty():
        pass
    return cover(state, vertices)


def heavy_labels(labels: DataFrame, k: int) -> DataFrame:
    """``label, cnt`` of labels that more than 1 / k of the vertices bear; fewer than k rows."""
    n = labels.agg(F.count(F.lit(1)).alias("n"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    return sizes.join(F.broadcast(n)).where(F.col("cnt") * k > F.col("n")).select("label", "cnt")  # one row


def heavy_jump_step(state: DataFrame, k: int) -> DataFrame:
    """:func:`pointer_jump_step` for heavy labels alone: fewer than ``k`` labels are looked up, and broadcast."""
    heavy = heavy_labels(state, k).select(F.col("label").alias("of"))
    root = F.broadcast(state.join(F.broadcast(heavy), F.col("v") == F.col("of")).select("of", F.col("label").alias("root")))
    return state.join(root, F.col("label") == F.col("of"), "left").select("v", F.least("label", F.coalesce("root", "label")).alias("label"))


def shortcut_propagation(edges: DataFrame, vertices: DataFrame, hitters: int | None = None) -> DataFrame:
    """As before, but every round also jumps to the label's label and tells the label that was left; O(log n) rounds on paths.
    With ``hitters`` only labels that more than one in so many vertices bear are jumped."""
    both = cut(symmetric(edges).distinct())
    state = endpoints(edges).select("v", F.col("v").alias("label"))
    while True:
        told = push_to_old_root(state, min_label_step(state, both))
        old = state.select("v", F.col("label").alias("old"))
        state = cut(heavy_jump_step(told, hitters) if hitters else pointer_jump_step(told))
        if state.join(old, "v").where(F.col("label") != F.col("old")).isEmpty():
            return cover(state, vertices)


# --- contraction ---------------------------------------------------------------------------------------------------


def quotient_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """The edges between different clusters, each ordered pair once. ``mapping`` is ``v, cv``; unmapped ends stay."""
    a = mapping.select(F.col("v").alias("a"), F.col("cv").alias("ca"))
    b = mapping.select(F.col("v").alias("b"), F.col("cv").alias("cb"))
    moved = edges.join(a, edges["src"] == F.col("a"), "left").join(b, F.col("dst") == F.col("b"), "left")
    moved = moved.select(F.coalesce("ca", "src").alias("src"), F.coalesce("cb", "dst").alias("dst"))
    return moved.where(F.col("src") != F.col("dst")).distinct()


def project_back(mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of a quotient graph's vertices, given to the vertices that were mapped to them."""
    known = labels.select(F.col("v").alias("known"), "label")
    return mapping.join(known, mapping["cv"] == F.col("known"), "left").select("v", F.coalesce("label", "cv").alias("label"))


def _payload(deviate: Column | str, label: Column | str) -> Column:
    return F.struct(F.col(deviate).alias("deviate") if isinstance(deviate, str) else deviate.alias("deviate"), F.col(label).alias("label") if isinstance(label, str) else label.alias("label"))


def shift_step(state: DataFrame, both: DataFrame, cost: int = 1) -> DataFrame:
    """Each vertex takes the least of its own (deviate, label) and its neighbours' (deviate + cost, label)."""
    heard = both.join(state, both["src"] == state["v"]).groupBy("dst").agg(F.min(_payload(F.col("deviate") + cost, "label")).alias("heard"))
    both_known = state.join(heard, state["v"] == heard["dst"], "left")
    own = _payload("deviate", "label")
    return both_known.select("v", F.least(own, F.coalesce("heard", own)).alias("best")).select("v", "best.deviate", "best.label")


def _shift(state: DataFrame, both: DataFrame) -> DataFrame:
    """One round of :func:`shift_step` in which only what ``changed`` in the round before is told."""
    told = state.where("changed").select(F.col("v").alias("from"), _payload(F.col("deviate") + 1, "label").alias("told"))
    heard = both.join(told, both["src"] == F.col("from")).groupBy("dst").agg(F.min("told").alias("heard"))
    own = _payload("deviate", "label")
    better = F.coalesce(F.col("heard") < own, F.lit(False))
    best = state.join(heard, state["v"] == heard["dst"], "left").select("v", F.when(better, F.col("heard")).otherwise(own).alias("best"), better.alias("changed"))
    return best.select("v", "best.deviate", "best.label", "changed")


def exponential_clusters(both: DataFrame, vertices: DataFrame, beta: float, seed: int, n: int, iteration: int = 0) -> DataFrame:
    """``v, deviate, label``: clusters of random starting times, relaxed until nothing changes."""
    state = vertices.select("v", start_time(F.col("v"), beta, seed, n, iteration).alias("deviate"), F.col("v").alias("label"), F.lit(True).alias("changed"))
    while not (state := cut(_shift(state, both))).where("changed").isEmpty():
        pass
    return state.drop("changed")


def exponential_clusters_by_rounds(both: DataFrame, vertices: DataFrame, beta: float, seed: int, n: int, iteration: int = 0) -> DataFrame:
    """``v, deviate, label``: the same clusters grown in time steps. Those that start in a step and are free wake, and what woke
    or was reached one step before reaches its free neighbours; the least label wins.

    Steps are taken in windows, each as long as all before, since ever fewer start: within a window what ``changed`` and may
    still reach another in it is told, until there is nothing to tell. What a window has reached is final. It is put on a
    shelf, and the next window goes on with what is free, and with what was reached in the last step.
    """
    free = cut(vertices.select("v", start_time(F.col("v"), beta, seed, n, iteration).alias("deviate"), F.col("v").alias("label"), F.lit(True).alias("changed")))
    shelf = Shelf(free.sparkSession, "v long, deviate long, label long")
    end = max(1, round(WINDOW / beta))
    front = None
    while not free.isEmpty():
        state, telling = free, F.col("changed") & (F.col("deviate") < end - 1)
        while front is not None or not state.where(telling).isEmpty():
            told = state.where(telling).select("v", "deviate", "label")
            state, front = cut(_reach(state, both, told if front is None else told.unionByName(front), end)), None
        shelf.add(state.where(F.col("deviate") < end).select("v", "deviate", "label"))
        front = shelf.last().where(F.col("deviate") == end - 1)
        free, end = cut(state.where(F.col("deviate") >= end)), 2 * end
    return shelf.taken()


def _reach(state: DataFrame, both: DataFrame, told: DataFrame, end: int) -> DataFrame:
    """One round of :func:`shift_step` in which ``told`` is told; what had changed and waits for a later window still does."""
    told = told.select(F.col("v").alias("from"), _payload(F.col("deviate") + 1, "label").alias("told"))
    heard = both.join(told, both["src"] == F.col("from")).groupBy("dst").agg(F.min("told").alias("heard"))
    own = _payload("deviate", "label")
    better = F.coalesce(F.col("heard") < own, F.lit(False))
    waits = F.col("changed") & (F.col("deviate") >= end - 1)
    best = state.join(heard, state["v"] == heard["dst"], "left").select("v", F.when(better, F.col("heard")).otherwise(own).alias("best"), (better | waits).alias("changed"))
    return best.select("v", "best.deviate", "best.label", "changed")


def two_hop_min(both: DataFrame, vertices: DataFrame, seed: int, iteration: int = 0) -> DataFrame:
    """``v, deviate, label``: every vertex takes the least (random deviate below 100, label) within two edges."""
    state = vertices.select("v", uniform_below(F.col("v"), 100, seed, iteration).alias("deviate"), F.col("v").alias("label"))
    return shift_step(shift_step(state, both, cost=0), both, cost=0)


def contraction(edges: DataFrame, vertices: DataFrame, clusters: Callable[[DataFrame, DataFrame, int], DataFrame], base: int, thin: bool = False, trace: list | None = None) -> DataFrame:
    """Cluster, contract, and again, until ``base`` directed edges are left; those are solved in one task.

    Each level's ``v, cv`` names a cluster by its least vertex, so that no last step has to rename labels. With ``thin`` every
    quotient is replaced by the spanning forests of its ranges of sources. ``trace`` is given a row for each level: its
    number, its edges, and the seconds until the next.
    """
    levels: list[DataFrame] = []
    both = cut(symmetric(edges).where(F.col("src") != F.col("dst")).distinct())
    while (left := both.count()) > base:
        began = time.perf_counter()
        active = cut(both.select(F.col("src").alias("v")).distinct())
        found = clusters(both, active, len(levels)).select("v", "label")
        mapping = cut(canonical(found).select("v", F.col("label").alias("cv")))
        levels.append(mapping)
        quotient = quotient_edges(both, mapping)
        both = cut(symmetric(local_forest(quotient.where("src < dst").repartitionByRange("src"))) if thin else quotient)
        if trace is not None:
            trace.append({"level": len(levels) - 1, "edges": left, "seconds": time.perf_counter() - began})
        if len(levels) > 60 and both.count() >= left:
            raise RuntimeError("the graph does not shrink")
    labels = in_one_task(both)
    for mapping in reversed(levels):
        labels = project_back(mapping, labels)
    return cover(labels, vertices)


def relative_base(edges: int, parts: int, factor: float = 1.0) -> int:
    """The edges below which one task solves the rest, as a share of those of the whole graph that each part has."""
    return int(edges / max(1, parts) * factor)


def exponential(edges: DataFrame, vertices: DataFrame, beta: float = 0.1, seed: int = 1, base: int = BASE_EDGES, by_rounds: bool = False, trace: list | None = None) -> DataFrame:
    """Contraction of exponentially shifted clusters."""
    grow = exponential_clusters_by_rounds if by_rounds else exponential_clusters
    return contraction(edges, vertices, lambda both, active, k: grow(both, active, beta, seed, active.count(), k), base, trace=trace)


def local_contraction(edges: DataFrame, vertices: DataFrame, seed: int = 1, base: int = BASE_EDGES, thin: bool = False, trace: list | None = None) -> DataFrame:
    """Contraction of two-hop clusters. Cheap rounds, which shrink a graph by a constant factor at least in expectation."""
    return contraction(edges, vertices, lambda both, active, k: two_hop_min(both, active, seed, k), base, thin, trace)


def default(edges: DataFrame, vertices: DataFrame, base: int = BASE_EDGES, trace: list | None = None) -> DataFrame:
    """Local forests, then one task for a small rest or distributed contraction, thinned at each level, of a large one."""
    forest = cut(local_forest(edges))
    if forest.count() <= base:
        return cover(in_one_task(forest), vertices)
    return local_contraction(forest, vertices, base=base, thin=True, trace=trace)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "default": default,
    "sequential": sequential,
    "label_propagation": label_propagation,
    "shortcut": shortcut_propagation,
    "exponential": exponential,
    "exponential_bfs": lambda edges, vertices, **conf: exponential(edges, vertices, by_rounds=True, **conf),
    "local_contraction": local_contraction,
}


@dataclass(frozen=True)
class Graph:
    """An undirected graph: ``edges`` with ``src, dst`` and ``vertices`` with ``v``, which may stand in no edge."""

    edges: DataFrame
    vertices: DataFrame

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """Rows with a null end are no edges and are dropped; without vertices, the edges' ends are meant."""
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
        ends = endpoints(edges)
        return Graph(edges, ends if vertices is None else vertices.select(F.col("v").cast("long").alias("v")).where("v is not null").union(ends).distinct())


def component_labels(graph: Graph, strategy: str = "default", **conf) -> DataFrame:
    """``v, label`` by the strategy of that name."""
    return STRATEGIES[strategy](graph.edges, graph.vertices, **conf)
