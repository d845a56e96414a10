"""``python -m weftgraph.cli -input edgefile -path edges.txt -out labels``: labels a graph and reports on it.

Sizes of generated graphs are given as powers of two with -n and -m, or as they are with -exact_n and -exact_m (always
for grids). -single, -contraction and -local first contract the graph by what its parts see: once, twice, or only inside
the parts. -replicate splits vertices of high degree first. -seq and -fixed-seq say when one task solves the rest. -direct
and -regular are taken and change nothing: there is one way in which rows are exchanged.
"""

from __future__ import annotations

import argparse
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.contraction import component_labels_by_parts, component_labels_of_split, split_high_degree
from weftgraph.operators.edges import high_degree
from weftgraph.operators.labels import component_count, size_histogram
from weftgraph.operators.partitions import round_robin
from weftgraph.plans.connectivity import STRATEGIES, Graph, component_labels, relative_base, symmetric
from weftgraph.sources.readers import Source, load_graph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("-input", choices=["file", "partition", "edgefile", "edgefiles", "binary"])
    p.add_argument("-path")
    p.add_argument("-out", help="a folder for the labels, as Parquet")
    p.add_argument("-gen")
    p.add_argument("-strategy", choices=sorted(STRATEGIES), default="default")
    p.add_argument("-beta", type=float, default=0.1)
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("-single", dest="mode", action="store_const", const="single", help="contract what the parts see, then solve the rest")
    mode.add_argument("-contraction", dest="mode", action="store_const", const="twice", help="the same twice")
    mode.add_argument("-local", dest="mode", action="store_const", const="local", help="the same for vertices without cut edges only")
    p.add_argument("-parts", type=int, help="parts, else as many as there are cores")
    p.add_argument("-bfs", action="store_true", help="exponential clusters grow in time steps")
    p.add_argument("-replicate", action="store_true", help="split vertices of high degree")
    p.add_argument("-hd-thres", dest="hd_thres", type=float, default=16.0, help="high is so many times the square root of the number of vertices")
    p.add_argument("-heavy-hitters", dest="hitters", type=int, help="shortcuts of labels alone that more than one in so many vertices bear")
    base = p.add_mutually_exclusive_group()
    base.add_argument("-fixed-seq", "-base", dest="base", type=int, help="edges that one task solves")
    base.add_argument("-seq", type=float, help="the same, as a multiple of the edges that each part has")
    p.add_argument("-direct", action="store_true")
    p.add_argument("-regular", action="store_true")
    p.add_argument("-i", type=int, default=1, help="runs")
    p.add_argument("-seed", type=int, default=1)
    p.add_argument("-n", type=int, default=18)
    p.add_argument("-m", type=int, default=18)
    p.add_argument("-exact_n", action="store_true")
    p.add_argument("-exact_m", action="store_true")
    p.add_argument("-r", type=float, default=0.01)
    p.add_argument("-gamma", type=float, default=2.8)
    p.add_argument("-d", type=int, default=4)
    p.add_argument("-p", type=float, default=1.0)
    p.add_argument("-periodic", action="store_true")
    p.add_argument("-verbose", action="store_true")
    return p


def source_of(args: argparse.Namespace, seed: int) -> Source:
    exact = args.gen == "grid_2d"
    n = args.n if exact or args.exact_n else 1 << args.n
    m = args.m if exact or args.exact_m else 1 << args.m
    return Source(args.input, args.path, args.gen, n, m, args.r, args.gamma, args.d, args.p, args.periodic, seed)


def solver_options(args: argparse.Namespace, edges: int, parts: int) -> tuple[str, dict]:
    """The strategy and its parameters."""
    strategy = "exponential_bfs" if args.bfs and args.strategy == "exponential" else args.strategy
    conf: dict = {}
    base = args.base if args.seq is None else relative_base(edges, parts, args.seq)
    if base is not None and strategy not in ("sequential", "label_propagation", "shortcut"):
        conf["base"] = base
    if strategy.startswith("exponential"):
        conf["beta"] = args.beta
    if strategy in ("exponential", "exponential_bfs", "local_contraction"):
        conf["seed"] = args.seed
    if strategy == "shortcut" and args.hitters:
        conf["hitters"] = args.hitters
    return strategy, conf


def solve(graph: Graph, args: argparse.Namespace, trace: list) -> DataFrame:
    """Labels of the graph in the mode that the arguments name."""
    parts = args.parts or graph.edges.sparkSession.sparkContext.defaultParallelism
    strategy, conf = solver_options(args, graph.edges.count() if args.seq is not None else 0, parts)
    if strategy not in ("sequential", "label_propagation", "shortcut"):
        conf["trace"] = trace
    both = symmetric(graph.edges)
    if args.replicate:
        split = split_high_degree(both, graph.vertices, high_degree(both, graph.vertices, args.hd_thres), max(1, parts - 1))
        return component_labels_of_split(*split, strategy=strategy, **conf)
    if args.mode:
        return component_labels_by_parts(both, graph.vertices, round_robin(parts), args.mode, strategy, **conf)
    return component_labels(graph, strategy, **conf)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[float]:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    seconds = []
    for run in range(args.i):
        graph = load_graph(spark, source_of(args, args.seed + run + (1000 if args.gen else 0)))
        began, trace = time.perf_counter(), []
        labels = solve(graph, args, trace)
        if args.out and run == 0:
            labels.write.mode("overwrite").parquet(args.out)
            labels = spark.read.parquet(args.out)
        counts = component_count(labels).first()
        seconds.append(time.perf_counter() - began)
        print(f"run={run} nontrivial={counts['num_nontrivial']} with_single={counts['num_all']} seconds={seconds[-1]:.3f}")
        if args.verbose:
            for level in trace:
                print(f"level={level['level']} edges={level['edges']} seconds={level['seconds']:.3f}")
            for row in size_histogram(labels).orderBy(F.col("size")).toLocalIterator():
                print(f"size={row['size']} (num={row['num']})")
    if len(seconds) > 1:
        print(f"mean={statistics.mean(seconds):.3f} deviation={statistics.stdev(seconds):.3f}")
    return seconds


if __name__ == "__main__":
    main()
