"""All strategies on small graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions.random import MODULUS, start_time
from weftgraph.operators.contraction import component_labels_of_split, split_high_degree
from weftgraph.operators.edges import breadth_first, degrees
from weftgraph.operators.labels import numbered
from weftgraph.operators.partitions import owners
from weftgraph.plans.connectivity import STRATEGIES, Graph, component_labels, endpoints, exponential_clusters, exponential_clusters_by_rounds, symmetric
from weftgraph.plans.lineage import Shelf, cut
from weftgraph.plans.unionfind import forest_edges, min_labels

BIG = 1 << 61
GRAPHS = {
    "empty": ([], []),
    "isolated": ([], [0, 1, 2, 3]),
    "two": ([(0, 2), (1, 2), (3, 4), (3, 5)], list(range(6))),
    "loop": ([(0, 0), (1, 2)], [0, 1, 2]),
    "repeats": ([(0, 1), (0, 1), (1, 0)], [0, 1]),
    "path": ([(i, i + 1) for i in range(24)], list(range(25))),
    "star": ([(0, i) for i in range(1, 40)], list(range(40))),
    "bridge": ([(0, i) for i in range(1, 15)] + [(100, i) for i in range(101, 115)] + [(0, 100)], []),
    "big": ([(BIG + 5, BIG + 1), (BIG + 1, 3), (BIG + 9, BIG + 8)], []),
    "negative": ([(-5, 3), (3, 9)], [-7]),
}


def expected(edges, vertices):
    parent = {v: v for v in [*vertices, *(x for e in edges for x in e)]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def graph_of(spark, edges, vertices):
    return Graph.of(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(v,) for v in vertices], "v long"))


def solve(graph, strategy, **conf):
    return {r["v"]: r["label"] for r in component_labels(graph, strategy, **conf).collect()}


@pytest.mark.parametrize("name", GRAPHS)
def test_default(spark, name):
    edges, vertices = GRAPHS[name]
    assert solve(graph_of(spark, edges, vertices), "default") == expected(edges, vertices)
    assert solve(graph_of(spark, edges, vertices), "default", base=0) == expected(edges, vertices)


@pytest.mark.parametrize("strategy", sorted(set(STRATEGIES) - {"default"}))
@pytest.mark.parametrize("name", ["two", "loop", "path", "bridge", "negative"])
def test_strategies(spark, strategy, name):
    edges, vertices = GRAPHS[name]
    if strategy.startswith("exponential") and name in ("path", "bridge"):
        return  # many rounds, each a job; the queries' tests have it on a larger graph
    conf = {"base": 0} if strategy in ("exponential", "exponential_bfs", "local_contraction") else {}
    if strategy.startswith("exponential"):
        conf["beta"] = 1.0  # fewer time steps, each a job
    assert solve(graph_of(spark, edges, vertices), strategy, **conf) == expected(edges, vertices)


def test_cut_forgets_the_sizes_that_were_guessed(spark):
    state = spark.range(100).withColumnRenamed("id", "v")
    for _ in range(20):
        state = cut(state.join(state.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select("v"))
    guess = state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(guess)).bit_length() <= 64 and state.count() == 100


@pytest.mark.parametrize("strategy", ["exponential", "local_contraction"])
def test_every_level_shrinks(spark, strategy):
    edges = [(i, i + 1) for i in range(3000)] + [(i, (i * 7919) % 3000) for i in range(0, 3000, 5)]
    trace = []
    assert set(solve(graph_of(spark, edges, []), strategy, base=50, trace=trace).values()) == {0}
    left = [x["edges"] for x in trace]
    assert len(left) <= 6 and all(b <= 0.6 * a for a, b in zip(left, left[1:])) and all(x["seconds"] > 0 for x in trace)


@pytest.mark.parametrize("apart", [MODULUS, 1 << 32, 3])
def test_iterations_start_anew(spark, apart):
    """Of two vertices that start together in one iteration, a twentieth does in the next, whatever their ids."""
    a = F.col("id") * 7919
    pair = spark.range(40_000).select(a.alias("a"), (a * F.col("id") + 3 if apart == 3 else a + apart).alias("b"))
    for k in range(1, 5):
        a, b = (start_time(F.col(c), 0.1, 1, 80_000, k) for c in pair.columns)
        pair = pair.where(a == b)
    assert pair.count() < 20  # 0.25 are expected


def test_many_pairs_are_contracted_in_few_levels(spark):
    edges = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + MODULUS).alias("dst"))
    trace = []
    labels = component_labels(Graph.of(edges), "exponential", base=20, trace=trace)
    assert labels.where(F.col("label") != F.col("v") % MODULUS).count() == 0 and labels.count() == 4000
    assert len(trace) <= 4


def test_clusters_by_rounds_are_the_same_in_few_windows(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)]
    both = cut(symmetric(graph_of(spark, edges, []).edges).where("src <> dst").distinct())
    windows, add = [], Shelf.add
    monkeypatch.setattr(Shelf, "add", lambda shelf, df: windows.append(add(shelf, df)))
    grown, relaxed = (sorted(map(tuple, f(both, endpoints(both), 0.1, 1, 160, 1).collect())) for f in (exponential_clusters_by_rounds, exponential_clusters))
    assert grown == relaxed and sum(windows) == len(grown) and len(windows) <= 4  # of 20, 20, 40, 80 steps


def test_shelf(spark):
    shelf = Shelf(spark, "v long")
    assert shelf.all().count() == 0
    assert [shelf.add(spark.range(n).withColumnRenamed("id", "v")) for n in (3, 0, 2)] == [3, 0, 2]
    assert shelf.last().count() == 2 and shelf.last(2).count() == 2
    assert sorted(r["v"] for r in shelf.taken().collect()) == [0, 0, 1, 1, 2]


def test_distances(spark):
    edges = [(i, i + 1) for i in range(12)] + [(0, 6), (20, 21)]
    both = symmetric(graph_of(spark, edges, []).edges)
    want = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 2, 6: 1, 7: 2, 8: 3, 9: 4, 10: 5, 11: 6, 12: 7}
    assert {r["v"]: r["distance"] for r in breadth_first(both, 0).collect()} == want
    assert {r["v"]: r["distance"] for r in breadth_first(both, 0, 2).collect()} == {v: d for v, d in want.items() if d <= 2}
    assert breadth_first(both, 99).count() == 0


def test_numbers_and_owners(spark):
    values = [5, -3, 1 << 61, 7, 0, 12]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert {r["v"]: r["number"] for r in numbered(rows, "v").collect()} == {v: i for i, v in enumerate(sorted(values))}
    assert numbered(rows.limit(0), "v").count() == 0
    owned = spark.createDataFrame([(0, 0, 1), (1, 1, 6), (2, 6, 6), (3, 6, 1000)], "pe long, low long, high long")
    assert {r["v"]: r["pe"] for r in owners(rows, owned).collect()} == {0: 0, 5: 1, 7: 3, 12: 3}


def test_null_ends_are_no_edges(spark):
    graph = Graph.of(spark.createDataFrame([(1, 2), (None, 3), (4, None)], "src long, dst long"))
    assert solve(graph, "default") == {1: 1, 2: 1}


def test_numpy_labels():
    rng = random.Random(3)
    for n in (1, 10, 200):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        a, b = (np.array(x, np.int64) for x in zip(*edges))
        assert dict(enumerate(min_labels(a, b, n).tolist())) == expected(edges, range(n))
        src, dst = forest_edges(a, b)
        assert expected(list(zip(src.tolist(), dst.tolist())), range(n)) == expected(edges, range(n))


@pytest.mark.parametrize("name", ["star", "bridge", "two"])
def test_split_keeps_labels(spark, name):
    edges, vertices = GRAPHS[name]
    graph = graph_of(spark, edges, vertices)
    both = symmetric(graph.edges)
    split = split_high_degree(both, graph.vertices, degrees(both).where("degree >= 3"), 4)
    assert {r["v"]: r["label"] for r in component_labels_of_split(*split).collect()} == expected(edges, vertices)
    assert split[0].where("salt > 0").count() > 0 or name == "two"
