"""Operators on component labels ``v, label``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import cut


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def size_histogram(labels: DataFrame) -> DataFrame:
    """``size, num``: how many connected sets have each size."""
    return component_sizes(labels).groupBy("size").agg(F.count(F.lit(1)).alias("num"))


def component_count(labels: DataFrame) -> DataFrame:
    """One row: connected sets of more than one vertex, and all."""
    return component_sizes(labels).agg(F.count_if(F.col("size") > 1).alias("num_nontrivial"), F.count(F.lit(1)).alias("num_all"))


def top_labels(labels: DataFrame, k: int) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "label").limit(k)


def same_component(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b, same``: whether each pair is connected."""
    a = labels.select(F.col("v").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce(F.col("la") == F.col("lb"), F.lit(False)).alias("same"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``number``: their place, from 0, in that order. Rows are dealt out by ranges and numbered in each; what is
    summed in one task has a row for each range, not for rows or their values."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("id", 33).alias("range")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first")))  # as many rows as shuffle partitions
    at = F.col("first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(first, F.shiftright("id", 33) == F.col("range")).select(*rows.columns, at.cast("long").alias("number"))


def dense_labels(labels: DataFrame) -> DataFrame:
    """``v, dense``: labels renumbered from 0 in order."""
    names = numbered(labels.select(F.col("label").alias("name")).distinct(), "name")
    return labels.join(names, F.col("label") == F.col("name")).select("v", F.col("number").alias("dense"))


def component_prefix_sum(local: DataFrame) -> DataFrame:
    """``pe, n_labels, offset, total``: labels of each part (``pe, label``), those before it, and all. One row a part."""
    counts = local.select("pe", "label").distinct().groupBy("pe").agg(F.count(F.lit(1)).alias("n_labels"))
    before = Window.orderBy("pe").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("pe").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select("pe", "n_labels", F.coalesce(F.sum("n_labels").over(before), F.lit(0)).alias("offset"), F.sum("n_labels").over(every).alias("total"))


def cluster_parents(state: DataFrame, both: DataFrame, starts: DataFrame) -> DataFrame:
    """``v, parent``: of a clustering ``v, deviate, label``, the least neighbour that supplied each vertex's pair; centres are
    their own parents. ``starts`` has ``v, start``."""
    supplied = both.join(state, both["src"] == state["v"]).select(F.col("dst").alias("at"), "src", (F.col("deviate") + 1).alias("d"), F.col("label").alias("l"))
    own = state.join(starts, "v")
    found = own.join(supplied, (F.col("v") == F.col("at")) & (F.col("deviate") == F.col("d")) & (F.col("label") == F.col("l")), "left")
    centre = (F.col("label") == F.col("v")) & (F.col("deviate") == F.col("start"))
    return found.groupBy("v").agg(F.min(F.when(centre, F.col("v")).otherwise(F.col("src"))).alias("parent"))


def label_shortcuts(state: DataFrame, parents: DataFrame, part) -> DataFrame:
    """``pe, label, parent``: for each part and label, the parent of the part's vertex of least (deviate, id)."""
    known = state.join(parents, "v").withColumn("pe", part(F.col("v")))
    return known.groupBy("pe", "label").agg(F.min_by("parent", F.struct("deviate", "v")).alias("parent"))


def run_statistics(runs: DataFrame, by: str, value: str) -> DataFrame:
    """``by, runs, mean, deviation``: the mean and the sample's standard deviation; null for one run."""
    return runs.groupBy(by).agg(F.count(value).alias("runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("deviation"))
