"""Readers of graph files. All give edges ``src, dst``, counted from 0; paths may be files, folders or patterns.

Text is read by Spark's reader and split by it. Where a line's number is its vertex (adjacency files), lines are
counted by split first; a line's number is then the sum of the splits before plus its place in its own, so that neither
a shuffle nor a single task is needed. Blank lines count, lines that begin with % don't.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.partitions import owners
from weftgraph.plans.connectivity import Graph, symmetric


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``line, value``: the lines that are no comments, numbered from 0 in order of file name and place."""
    place = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    rows = place.where(~F.col("value").startswith("%")).withColumn("id", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    starts = splits.select(F.col("file").alias("f"), F.col("at").alias("a"), "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    located = rows.join(starts, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")))
    return located.select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def _numbers(value: Column) -> Column:
    """The numbers of a line up to the first 0 or word."""
    numbers = F.transform(F.array_remove(F.split(F.trim(F.translate(value, "\t\r", "  ")), " +"), ""), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    stop = F.array_position(numbers, F.lit(0).cast("long"))
    return F.when(stop > 0, F.slice(numbers, F.lit(1), (stop - 1).cast("int"))).otherwise(numbers)


def _adjacency(lines: DataFrame, skip: Column | int, n: Column) -> DataFrame:
    """Edges of lines numbered from ``skip``; lines past vertex ``n`` - 1 are not part of the graph."""
    v = (F.col("line") - skip).cast("long")
    body = lines.where((v >= 0) & (v < n)).select(v.alias("src"), F.explode(_numbers(F.col("value"))).alias("dst"))
    return body.select("src", (F.col("dst") - 1).alias("dst"))


def read_adjacency(spark: SparkSession, path: str) -> Graph:
    """Adjacency text: a header ``n m``, then a line of neighbours, counted from 1, for each vertex. The header's m and what
    follows it are not checked. A blank line is a vertex without edges."""
    lines = _numbered(spark, path)
    n = int(lines.where(F.col("line") == 0).select(_numbers(F.col("value"))[0]).first()[0])
    return Graph(_adjacency(lines, 1, F.lit(n)), spark.range(n).select(F.col("id").alias("v")))


def read_adjacency_parts(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The same with a header ``n m parts`` and ``parts`` lines with the parts' sizes; also ``v, part``. A row a part is
    held on the driver."""
    lines = _numbered(spark, path)
    n, _, parts = (int(x) for x in lines.where(F.col("line") == 0).select(_numbers(F.col("value"))).first()[0][:3])
    sizes = {r["line"]: int(r["value"].split()[0]) for r in lines.where((F.col("line") > 0) & (F.col("line") <= parts)).collect()}
    ends = np.cumsum([sizes[i + 1] for i in range(parts)]).tolist()
    owned = spark.createDataFrame([(i, (ends[i - 1] if i else 0), ends[i]) for i in range(parts)], "pe long, low long, high long")
    vertices = spark.range(n).select(F.col("id").alias("v"))
    of = owners(vertices, owned).withColumnRenamed("pe", "part")
    return Graph(_adjacency(lines, parts + 1, F.lit(n)), vertices), of


def _edge_lines(lines: DataFrame, marked: bool) -> DataFrame:
    words = F.array_remove(F.split(F.trim(F.translate("value", "\t\r", "  ")), " +"), "")
    at = lambda i: F.get(words, F.lit(i)).try_cast("long")
    edges = lines.where(F.col("value").startswith("e")) if marked else lines
    return edges.select((at(1) - 1).alias("src"), (at(2) - 1).alias("dst")).where("src is not null and dst is not null")


def read_edge_list(spark: SparkSession, path: str) -> Graph:
    """Edge text: a header ``<type> n m``, then lines ``e u v``, counted from 1; other lines are passed over. Both directions."""
    lines = spark.read.text(path)
    header = lines.where(~F.col("value").startswith("%") & ~F.col("value").startswith("e"))
    n = int(header.select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(1)).try_cast("long").alias("n")).where("n is not null").first()[0])
    return Graph(symmetric(_edge_lines(lines, marked=True)), spark.range(n).select(F.col("id").alias("v")))


def read_edge_list_parts(spark: SparkSession, path: str) -> Graph:
    """Files ``<path>_0, <path>_1, ...``, each with its header; the first word of a line is not looked at. Both directions.
    A folder of files in the order of their names is one such file, with one header. A header a file is broadcast."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    depth = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).depth()
    unit = F.substring_index(F.regexp_replace("file", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), "/", depth + 1)  # what is below belongs to it
    place = spark.read.text(f"{path}_*").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    rows = place.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select("value", unit.alias("unit"), F.struct("file", "at", F.monotonically_increasing_id().alias("id")).alias("order"))
    heads = rows.groupBy("unit").agg(F.min("order").alias("head"), F.min_by("value", "order").alias("header"))
    n = int(heads.agg(F.max(F.get(F.split(F.trim("header"), r"\s+"), F.lit(1)).cast("long"))).first()[0])
    body = rows.join(F.broadcast(heads.select(F.col("unit").alias("of"), "head")), F.col("unit") == F.col("of")).where(F.col("order") != F.col("head"))
    return Graph(symmetric(_edge_lines(body, marked=False)), spark.range(n).select(F.col("id").alias("v")))


def read_binary(spark: SparkSession, path: str) -> Graph:
    """Records of two unsigned 64-bit numbers in this machine's order: first n and m, then the edges, counted from 1. Both
    directions. Spark's reader of fixed records splits the file; the records are taken apart in the JVM."""
    records = spark.sparkContext.binaryRecords(path, 16)
    encoder = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.BINARY()
    rows = DataFrame(spark._jsparkSession.createDataset(records._jrdd.rdd(), encoder).toDF(), spark).select(F.monotonically_increasing_id().alias("at"), F.hex("value").alias("digits"))
    places = range(7, -1, -1) if sys.byteorder == "little" else range(8)
    number = lambda first: F.conv(F.concat(*(F.substring("digits", 2 * (first + k) + 1, 2) for k in places)), 16, 10).cast("long")
    n = rows.limit(1).select(number(0).alias("n")).first()["n"]
    body = rows.where(F.col("at") > 0).select((number(0) - 1).alias("src"), (number(8) - 1).alias("dst"))  # the header is the first record of the first split
    return Graph(symmetric(body), spark.range(n).select(F.col("id").alias("v")))


@dataclass(frozen=True)
class Source:
    """Where a graph comes from: ``input`` names a kind of file at ``path``, else ``gen`` names a generator."""

    input: str | None = None
    path: str | None = None
    gen: str | None = None
    n: int = 1 << 18
    m: int = 1 << 18
    r: float = 0.01
    gamma: float = 2.8
    d: int = 4
    p: float = 1.0
    periodic: bool = False
    seed: int = 1


def load_graph(spark: SparkSession, source: Source) -> Graph:
    """The graph of a file or of a generator."""
    from weftgraph.sources import generators

    files = {"file": read_adjacency, "partition": lambda s, p: read_adjacency_parts(s, p)[0], "edgefile": read_edge_list, "edgefiles": read_edge_list_parts, "binary": read_binary}
    if source.input in files:
        return files[source.input](spark, source.path)
    if source.input is None and source.gen in generators.GENERATORS:
        return generators.GENERATORS[source.gen](spark, source)
    raise ValueError(f"neither a known kind of file nor a generator: {source.input}, {source.gen}")
