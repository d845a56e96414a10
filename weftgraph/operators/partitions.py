"""Operators on a graph whose vertices are dealt out to parts: ghosts, cut edges, interfaces, ranges.

``part`` maps a column of vertices to a column of part numbers. A ghost is a vertex of another part that a part's vertex
has an edge to; an interface vertex has such an edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.labels import numbered
from weftgraph.plans.connectivity import default
from weftgraph.plans.lineage import cut

Part = Callable[[Column], Column]


def round_robin(parts: int, step: int = 1) -> Part:
    """Vertices ``step`` by ``step`` dealt out in turn."""
    return lambda v: F.pmod(F.floor(v / step).cast("long"), F.lit(parts)).cast("long")


def cut_edges(both: DataFrame, part: Part) -> DataFrame:
    return both.where(part(F.col("src")) != part(F.col("dst")))


def ghosts(both: DataFrame, part: Part) -> DataFrame:
    """``pe, v, owner``: the ghosts of each part."""
    return cut_edges(both, part).select(part(F.col("src")).alias("pe"), F.col("dst").alias("v"), part(F.col("dst")).alias("owner")).distinct()


def interface(both: DataFrame, part: Part) -> DataFrame:
    return cut_edges(both, part).select(F.col("src").alias("v")).distinct()


def interior(both: DataFrame, vertices: DataFrame, part: Part) -> DataFrame:
    return vertices.join(interface(both, part), "v", "left_anti")


def adjacent_parts(both: DataFrame, part: Part) -> DataFrame:
    """``pe, other``: parts with an edge between them."""
    return cut_edges(both, part).select(part(F.col("src")).alias("pe"), part(F.col("dst")).alias("other")).distinct()


def part_vertices(both: DataFrame, vertices: DataFrame, part: Part) -> DataFrame:
    """``pe, v, ghost``: all that a part holds, its own vertices and its ghosts."""
    own = vertices.select(part(F.col("v")).alias("pe"), "v", F.lit(False).alias("ghost"))
    return own.unionByName(ghosts(both, part).select("pe", "v", F.lit(True).alias("ghost")))


def local_ids(vertices: DataFrame, part: Part) -> DataFrame:
    """``v, pe, local_id``: each part's vertices numbered from 0. All are numbered by part and id, so that no task has to
    number a whole part."""
    placed = cut(numbered(vertices.select("v", part(F.col("v")).alias("pe")), "pe", "v"))
    first = F.broadcast(placed.groupBy("pe").agg(F.min("number").alias("first")))  # one row a part
    return placed.join(first, "pe").select("v", "pe", (F.col("number") - F.col("first")).alias("local_id"))


def ranges(vertices: DataFrame, parts: int) -> DataFrame:
    """``pe, low, high``: the id space from 0 to the largest id, cut into equal ranges that exclude their end."""
    space = vertices.agg(F.ceil((F.max("v") + 1) / F.lit(parts)).cast("long").alias("step"))
    return space.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("pe"), "step").select("pe", (F.col("pe") * F.col("step")).alias("low"), ((F.col("pe") + 1) * F.col("step")).alias("high"))


def owners(vertices: DataFrame, owned: DataFrame) -> DataFrame:
    """``v, pe`` of the range ``low`` to ``high``, its end excluded, that holds a vertex; ``owned`` has a row for each range.

    Ranges, which may be unequal, are laid on a grid of about four cells a range, and vertices meet those of their cell:
    a join by equality, of which each side may be large.
    """
    width = owned.agg(F.greatest(F.lit(1), F.ceil((F.max("high") - F.min("low")) / (4 * F.greatest(F.lit(1), F.count(F.lit(1)))))).cast("long").alias("width"))
    cell = lambda x: F.floor(x / F.col("width")).cast("long")
    laid = owned.where("low < high").join(F.broadcast(width)).withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))  # one row is broadcast
    placed = vertices.join(F.broadcast(width)).select("v", cell(F.col("v")).alias("cell"))
    return placed.join(laid.select("cell", "low", "high", "pe"), "cell").where((F.col("v") >= F.col("low")) & (F.col("v") < F.col("high"))).select("v", "pe")


def owners_of_equal_ranges(vertices: DataFrame, parts: int) -> DataFrame:
    """``v, pe`` where the ids from 0 to the largest are cut into equal ranges: a division, without a join of the ranges."""
    space = vertices.agg(F.ceil((F.max("v") + 1) / F.lit(parts)).cast("long").alias("step"))
    return vertices.join(F.broadcast(space)).select("v", F.floor(F.col("v") / F.col("step")).cast("long").alias("pe"))  # one row is broadcast


def part_stats(both: DataFrame, vertices: DataFrame, part: Part) -> DataFrame:
    """``pe, n, m, cut, max_degree``: vertices, edge slots, cut edge slots and the largest degree of each part."""
    is_cut = part(F.col("src")) != part(F.col("dst"))
    per_vertex = both.groupBy("src").agg(F.count(F.lit(1)).alias("slots"), F.count_if(is_cut).alias("cut"))
    known = vertices.join(per_vertex, vertices["v"] == per_vertex["src"], "left").withColumn("pe", part(F.col("v")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return known.groupBy("pe").agg(F.count(F.lit(1)).alias("n"), zero(F.sum("slots")).alias("m"), zero(F.sum("cut")).alias("cut"), zero(F.max("slots")).alias("max_degree"))


def graph_params(both: DataFrame, vertices: DataFrame, part: Part) -> DataFrame:
    """One row: ``n, m, min_cut, max_cut, max_degree`` over all parts."""
    return part_stats(both, vertices, part).agg(
        F.sum("n").alias("n"), (F.sum("m") / 2).cast("long").alias("m"), F.min("cut").alias("min_cut"), F.max("cut").alias("max_cut"), F.max("max_degree").alias("max_degree")
    )


def mean_max_degree(both: DataFrame, vertices: DataFrame, part: Part, parts: int) -> DataFrame:
    """One row: the parts' largest degrees, summed and divided by the number of parts as whole numbers are."""
    return part_stats(both, vertices, part).agg(F.floor(F.sum("max_degree") / parts).cast("long").alias("avg_max_degree"))


def part_ranges(both: DataFrame, part: Part) -> DataFrame:
    """``pe, first_v, last_v, first_dst, last_dst``: a part's first and last source, and the first and last target of the first."""
    per = both.groupBy(part(F.col("src")).alias("pe"), "src").agg(F.min("dst").alias("low"), F.max("dst").alias("high"))
    first = F.min(F.struct("src", "low", "high"))
    return per.groupBy("pe").agg(first.alias("f"), F.max("src").alias("last_v")).select("pe", F.col("f.src").alias("first_v"), "last_v", F.col("f.low").alias("first_dst"), F.col("f.high").alias("last_dst"))


def local_component_labels(both: DataFrame, vertices: DataFrame, part: Part) -> DataFrame:
    """``pe, v, label``: connected sets of what each part sees, its vertices and its ghosts; so two of its vertices that share a
    ghost are together. The label is the least of the part's own vertices.

    Solved as one graph whose vertices are (part, vertex); those pairs are named by a hash, since ids may be large.
    """
    node = lambda v: F.xxhash64("pe", v)
    seen = both.withColumn("pe", part(F.col("src"))).select(node("src").alias("src"), node("dst").alias("dst"))
    own = vertices.select(part(F.col("v")).alias("pe"), "v").withColumn("node", node("v"))
    labels = default(seen, own.select(F.col("node").alias("v")))
    raw = own.join(labels.select(F.col("v").alias("node"), F.col("label").alias("raw")), "node")
    least = raw.groupBy("raw").agg(F.min("v").alias("label"))
    return raw.join(least, "raw").select("pe", "v", "label")


def message_volume(both: DataFrame, part: Part) -> DataFrame:
    """``pe, other, messages``: vertices whose state a part sends to another one, each once."""
    sent = cut_edges(both, part).select(part(F.col("src")).alias("pe"), part(F.col("dst")).alias("other"), "src").distinct()
    return sent.groupBy("pe", "other").agg(F.count(F.lit(1)).alias("messages"))
