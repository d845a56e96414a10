"""Properties that hold for any graph."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from test_connectivity import expected

from weftgraph.plans.connectivity import Graph, component_labels, project_back, quotient_edges, symmetric, two_hop_min
from weftgraph.plans.unionfind import forest_edges, forest_of_partition, label_all

EDGES = st.lists(st.tuples(st.integers(-(2**62), 2**62) | st.integers(0, 9), st.integers(0, 9)), max_size=30)


def arrays(edges):
    return (np.array([e[k] for e in edges], np.int64) for k in (0, 1))


@given(EDGES)
def test_forests_keep_labels(edges):
    src, dst = forest_edges(*arrays(edges))
    vertices = {x for e in edges for x in e}
    assert expected(list(zip(src.tolist(), dst.tolist())), vertices) == expected(edges, vertices)
    assert len(src) == len(vertices) - len(set(expected(edges, vertices).values()))


@given(EDGES, st.integers(1, 7))
def test_batches_do_not_matter(edges, size):
    frames = [pd.DataFrame(edges[i : i + size], columns=["src", "dst"]) for i in range(0, len(edges), size)]
    forest = pd.concat(list(forest_of_partition(frames)))
    vertices = {x for e in edges for x in e}
    assert expected(list(zip(forest["src"].tolist(), forest["dst"].tolist())), vertices) == expected(edges, vertices)
    labels = [r for f in label_all(frames) for r in zip(f["v"].tolist(), f["label"].tolist())]
    assert dict(labels) == expected(edges, [])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20), st.randoms())
def test_contraction_and_renaming(spark, edges, random):
    graph = Graph.of(spark.createDataFrame(edges, "src long, dst long"))
    both = symmetric(graph.edges)
    mapping = two_hop_min(both, graph.vertices, 1).select("v", "label").withColumnRenamed("label", "cv")
    quotient = quotient_edges(both, mapping)
    labels = component_labels(Graph.of(quotient))
    raw = {r["v"]: r["label"] for r in project_back(mapping, labels).collect()}
    want = expected(edges, [])
    assert len(set(raw.values())) == len(set(want.values()))
    assert all((raw[a] == raw[b]) == (want[a] == want[b]) for a in want for b in want)

    names = random.sample(range(100, 200), 13)
    renamed = [(names[a], names[b]) for a, b in edges]
    got = {r["v"]: r["label"] for r in component_labels(Graph.of(spark.createDataFrame(renamed, "src long, dst long"))).collect()}
    assert got == expected(renamed, [])
