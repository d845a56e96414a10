"""Readers on files as they are written by hand; generators' structure; the command line."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_connectivity import expected

from weftgraph import cli
from weftgraph.plans.connectivity import component_labels
from weftgraph.sources import generators
from weftgraph.sources.readers import Source, load_graph, read_adjacency, read_adjacency_parts
from weftgraph.sources.writers import write_edge_list_parts


def pairs(graph):
    return sorted((r["src"], r["dst"]) for r in graph.edges.collect())


def file(tmp_path, text, name="graph"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


SIMPLE = [(0, 2), (1, 2), (2, 0), (2, 1), (3, 4), (3, 5), (4, 3), (5, 3)]


def test_adjacency(spark, tmp_path):
    graph = read_adjacency(spark, file(tmp_path, "6 5\n3\n3\n1 2\n5 6\n4\n4\n"))  # the header's 5 is wrong and not looked at
    assert pairs(graph) == SIMPLE and graph.vertices.count() == 6


def test_adjacency_comments_and_blank_lines(spark, tmp_path):
    text = "% first\n% second\n7 4\n3\n3\n% in between\n1 2\n5 6\n4\n4\n\n"
    graph = read_adjacency(spark, file(tmp_path, text))
    assert pairs(graph) == SIMPLE
    assert {r["v"]: r["label"] for r in component_labels(graph).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}


def test_adjacency_stops_at_what_is_no_number(spark, tmp_path):
    assert pairs(read_adjacency(spark, file(tmp_path, "3 2\n2 0 3\n1 x 3\n\n"))) == [(0, 1), (1, 0)]


def test_adjacency_over_many_splits(spark, tmp_path):
    n = 3000
    text = f"{n} {n - 1}\n" + "".join(" ".join(str(x + 1) for x in (i - 1, i + 1) if 0 <= x < n) + "\n" for i in range(n))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        graph = read_adjacency(spark, file(tmp_path, text))
        assert pairs(graph) == sorted((i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_adjacency_parts(spark, tmp_path):
    graph, of = read_adjacency_parts(spark, file(tmp_path, "6 4 2\n4\n2\n3\n3\n1 2\n5 6\n4\n4\n"))
    assert pairs(graph) == SIMPLE
    assert sorted((r["v"], r["part"]) for r in of.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]


def test_edge_list(spark, tmp_path):
    graph = load_graph(spark, Source("edgefile", file(tmp_path, "% c\np 6 4\ne 1 3\ne 2 3\nx 1 6\ne 4 5\ne 4 6\n")))
    assert pairs(graph) == SIMPLE and graph.vertices.count() == 6


def test_edge_list_parts(spark, tmp_path):
    file(tmp_path, "p 6 4\ne 1 3\ne 2 3\n", "g_0")
    file(tmp_path, "p 6 4\na 4 5\na 4 6\n", "g_1")
    assert pairs(load_graph(spark, Source("edgefiles", str(tmp_path / "g")))) == SIMPLE


def test_edge_list_parts_of_folders_of_files(spark, tmp_path):
    for k, (first, second) in enumerate([("p 6 4\ne 1 3\n", "e 2 3\n"), ("% c\n\n", "p 6 4\na 4 5\na 4 6\n")]):
        (tmp_path / f"g h_{k}").mkdir()
        file(tmp_path / f"g h_{k}", first, "part-00000")
        file(tmp_path / f"g h_{k}", second, "part-00001")
    graph = load_graph(spark, Source("edgefiles", str(tmp_path / "g h")))
    assert pairs(graph) == SIMPLE and graph.vertices.count() == 6


def test_edge_list_parts_written_in_many_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 200).alias("dst"))
        write_edge_list_parts(edges, 400, 2, str(tmp_path / "g"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(list((tmp_path / "g_0").glob("part-*"))) > 1
    graph = load_graph(spark, Source("edgefiles", str(tmp_path / "g")))
    assert pairs(graph) == sorted([(i, i + 200) for i in range(200)] + [(i + 200, i) for i in range(200)]) and graph.vertices.count() == 400


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        load_graph(spark, Source("what"))


def test_generators(spark):
    ordered = lambda g: [(a, b) for a, b in pairs(g) if a < b]
    gnm = generators.gnm(spark, 100, 300)
    assert len(pairs(gnm)) == len(set(pairs(gnm))) == 600
    assert len(pairs(generators.gnm(spark, 4, 100))) == 12 and pairs(generators.gnm(spark, 3, 0)) == []
    assert len(ordered(generators.grid_2d(spark, 5, 7, periodic=True))) == 70
    kept = len(ordered(generators.grid_2d(spark, 40, 40, p=0.5)))
    assert 1300 < kept < 1820  # 3120 edges
    n = 200
    xy = {r["v"]: (r["x0"], r["x1"]) for r in generators.points(spark, n, 2).collect()}
    near = [(a, b) for a in range(n) for b in range(a + 1, n) if sum((p - q) ** 2 for p, q in zip(xy[a], xy[b])) <= 0.01]
    assert ordered(generators.rgg(spark, n, 0.1)) == near
    assert ordered(generators.rgg(spark, 300, 0.2, 3))
    ba = ordered(generators.ba(spark, 300, 3))
    assert all(a < b for a, b in ba) and set(expected(ba, range(300)).values()) == {0}
    rhg = generators.rhg(spark, 500)
    degree = len(pairs(rhg)) / 500
    assert 3 < degree < 20


def test_delaunay(spark):
    n = 600
    one = pairs(generators.rdg(spark, n, cell=10_000))
    many = pairs(generators.rdg(spark, n, cell=60))
    planar = 3 * n - 6
    assert planar - 40 <= len(one) // 2 <= planar
    assert len(set(one) ^ set(many)) <= 0.02 * len(one)  # at the hull, where circles are large


def test_cli(spark, tmp_path, capsys):
    path = file(tmp_path, "6 5\n3\n3\n1 2\n5 6\n4\n4\n")
    seconds = cli.main(["-input", "file", "-path", path, "-verbose", "-i", "2", "-out", str(tmp_path / "labels")], spark)
    said = capsys.readouterr().out
    assert len(seconds) == 2 and "nontrivial=2" in said and "size=3 (num=2)" in said
    assert spark.read.parquet(str(tmp_path / "labels")).count() == 6


@pytest.mark.parametrize("d, n", [(2, 40), (3, 24)])
def test_delaunay_has_the_edges_of_simplices_with_empty_balls(spark, d, n):
    points = np.array([[r[f"x{k}"] for k in range(d)] for r in generators.points(spark, n, d).orderBy("v").collect()])
    want = set()
    for corners in itertools.combinations(range(n), d + 1):
        ball = generators._balls(points, np.array([corners]))[0]
        others = [i for i in range(n) if i not in corners]
        if (((points[others] - ball[:d]) ** 2).sum(axis=1) > ball[d]).all():
            want |= set(itertools.combinations(corners, 2))
    assert {p for p in pairs(generators.rdg(spark, n, d, cell=1000)) if p[0] < p[1]} == want


def test_delaunay_in_cells_of_three_dimensions(spark):
    one, many = (set(pairs(generators.rdg(spark, 500, 3, cell=c))) for c in (1000, 60))
    assert len(one ^ many) <= 0.1 * len(one)  # nearly all of so few points are at the hull


def test_hyperbolic_pairs(spark, monkeypatch):
    monkeypatch.setattr(generators, "MET", 20)
    n, seed = 300, 1
    radius = 2 * math.log(2 * n * (0.9 / 0.4) ** 2 / (math.pi * 8))
    unit = lambda k: F.col(f"u{k}")
    rows = spark.range(n).select(F.col("id").alias("v"), *(generators._unit(F.col("id"), k, seed).alias(f"u{k}") for k in (1, 2))).select("v", unit(1), unit(2)).orderBy("v").collect()
    r = [min(radius, math.acosh(1 + x["u1"] * (math.cosh(0.9 * radius) - 1)) / 0.9) for x in rows]
    t = [x["u2"] * 2 * math.pi for x in rows]
    far = lambda a, b: math.cosh(r[a]) * math.cosh(r[b]) - math.sinh(r[a]) * math.sinh(r[b]) * math.cos(t[a] - t[b])
    want = [(a, b) for a in range(n) for b in range(a + 1, n) if far(a, b) <= math.cosh(radius)]
    assert [p for p in pairs(generators.rhg(spark, n, 2.8, 8, seed)) if p[0] < p[1]] == want


def test_the_first_of_many_keys(spark, monkeypatch):
    monkeypatch.setattr(generators, "ORDERED", 8)
    keys = sorted({(i * i * 31) % 100_003 for i in range(3000)})
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [generators._cutoff(rows, "k", m, 100_003) for m in (1, 700, len(keys))] == [keys[0], keys[699], keys[-1]]


@pytest.mark.parametrize("flags", [["-single"], ["-contraction", "-strategy", "exponential", "-fixed-seq", "0", "-bfs", "-beta", "1"], ["-local", "-strategy", "sequential"], ["-replicate", "-hd-thres", "0.5"], ["-seq", "0.5", "-strategy", "local_contraction"], ["-strategy", "shortcut", "-heavy-hitters", "4", "-direct"]])
def test_cli_modes(spark, tmp_path, flags):
    path = file(tmp_path, "6 5\n3\n3\n1 2\n5 6\n4\n4\n")
    cli.main(["-input", "file", "-path", path, "-parts", "3", "-out", str(tmp_path / "labels"), *flags], spark)
    assert {r["v"]: r["label"] for r in spark.read.parquet(str(tmp_path / "labels")).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
