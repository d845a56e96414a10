"""Operators that contract a graph by the connected sets its parts see, and that undo contractions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.partitions import Part, cut_edges, ghosts, interface, local_component_labels
from weftgraph.plans.connectivity import Graph, component_labels, project_back, quotient_edges
from weftgraph.plans.lineage import cut


def component_graph(both: DataFrame, local: DataFrame) -> DataFrame:
    """The quotient by the parts' connected sets (``pe, v, label``): edges between different ones, each ordered pair once."""
    return quotient_edges(both, local.select("v", F.col("label").alias("cv")))


def local_contraction_graph(both: DataFrame, local: DataFrame, part: Part) -> DataFrame:
    """The quotient in which only vertices without cut edges merge; interface vertices keep their ids."""
    on_edge = interface(both, part).select(F.col("v").alias("on_edge"))
    mapping = local.join(on_edge, F.col("v") == F.col("on_edge"), "left").select("v", F.coalesce("on_edge", "label").alias("cv"))
    return quotient_edges(both, mapping)


def component_labels_by_parts(both: DataFrame, vertices: DataFrame, part: Part, mode: str = "single", strategy: str = "default", **conf) -> DataFrame:
    """``v, label`` by what the parts see first: their connected sets are contracted (``single``), twice (``twice``), or only
    their vertices without cut edges are (``local``); what is left is solved by the strategy and projected back."""
    mappings: list[DataFrame] = []
    for _ in range(2 if mode == "twice" else 1):
        local = cut(local_component_labels(both, vertices, part))
        if mode == "local":
            on_edge = interface(both, part).select(F.col("v").alias("on_edge"))
            mapping = local.join(on_edge, F.col("v") == F.col("on_edge"), "left").select("v", F.coalesce("on_edge", "label").alias("cv"))
        else:
            mapping = local.select("v", F.col("label").alias("cv"))
        mappings.append(cut(mapping))
        both = cut(quotient_edges(both, mapping))
        vertices = mappings[-1].select(F.col("cv").alias("v")).distinct()
    labels = component_labels(Graph(both, vertices), strategy, **conf)
    for mapping in reversed(mappings):
        labels = project_back(mapping, labels)
    return labels


def ghost_component_labels(both: DataFrame, local: DataFrame, part: Part) -> DataFrame:
    """``pe, v, cv``: the component, at its owner, of each part's ghosts."""
    owned = local.select(F.col("v").alias("at"), F.col("label").alias("cv"))
    return ghosts(both, part).join(owned, F.col("v") == F.col("at")).select("pe", "v", "cv")


def largest_interface_component(both: DataFrame, local: DataFrame, part: Part) -> DataFrame:
    """``pe, other, cv, cnt``: for each pair of adjacent parts, the first one's component with most vertices next to the second."""
    edge = cut_edges(both, part).select(F.col("src").alias("at"), part(F.col("dst")).alias("other")).distinct()
    counts = edge.join(local, F.col("at") == F.col("v")).groupBy("pe", "other", F.col("label").alias("cv")).agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("pe", "other").agg(F.min(F.struct((-F.col("cnt")).alias("least"), "cv")).alias("best"))
    return best.select("pe", "other", F.col("best.cv").alias("cv"), (-F.col("best.least")).alias("cnt"))


def compose(levels: list[DataFrame]) -> DataFrame:
    """``v, cv`` through several levels of ``v, cv``; a vertex that a level does not map stays what it is."""

    def through(first: DataFrame, second: DataFrame) -> DataFrame:
        after = second.select(F.col("v").alias("at"), F.col("cv").alias("after"))
        return first.join(after, F.col("cv") == F.col("at"), "left").select("v", F.coalesce("after", "cv").alias("cv"))

    return reduce(through, levels)


def split_high_degree(both: DataFrame, vertices: DataFrame, heavy: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(v, salt)`` and symmetric edges between them, in which ``heavy`` (``v, degree``) ones are split.

    A heavy vertex has min(most, sqrt(degree)) proxies, salts from 1; a hash of an edge chooses the proxy at either end, and
    each proxy is linked to salt 0, the vertex. ``vertices`` come back with their salts, edges as ``src, src_salt, dst,
    dst_salt``. Connected sets stay what they were.
    """
    proxies = heavy.select("v", F.least(F.lit(most), F.floor(F.sqrt(F.col("degree").cast("double")))).cast("int").alias("k")).where(F.col("k") > 0)

    def salted(edges: DataFrame, end: str, other: str) -> DataFrame:
        near = proxies.select(F.col("v").alias("at"), F.col("k").alias("k"))
        salt = F.when(F.col("k").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.col("k")).cast("int"))
        return edges.join(near, F.col(end) == F.col("at"), "left").withColumn(f"{end}_salt", salt).drop("at", "k")

    moved = salted(salted(both, "src", "dst"), "dst", "src").select("src", "src_salt", "dst", "dst_salt")
    every = proxies.select("v", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("salt"))
    zero = F.lit(0)
    links = every.select(F.col("v").alias("src"), F.col("salt").alias("src_salt"), F.col("v").alias("dst"), zero.alias("dst_salt"))
    back = every.select(F.col("v").alias("src"), zero.alias("src_salt"), F.col("v").alias("dst"), F.col("salt").alias("dst_salt"))
    return vertices.select("v", zero.alias("salt")).unionByName(every), moved.unionByName(links).unionByName(back)


def component_labels_of_split(split_vertices: DataFrame, split_edges: DataFrame, strategy: str = "default", **conf) -> DataFrame:
    """``v, label`` of the vertices themselves, solved on the split graph; salted vertices are named by a hash."""
    node = lambda v, salt: F.xxhash64(v, salt)
    named = split_vertices.withColumn("node", node("v", "salt"))
    edges = split_edges.select(node("src", "src_salt").alias("src"), node("dst", "dst_salt").alias("dst"))
    labels = component_labels(Graph(edges, named.select(F.col("node").alias("v"))), strategy, **conf)
    raw = named.where(F.col("salt") == 0).join(labels.select(F.col("v").alias("node"), F.col("label").alias("raw")), "node")
    least = raw.groupBy("raw").agg(F.min("v").alias("label"))
    return raw.join(least, "raw").select("v", "label")
