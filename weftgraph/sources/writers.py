"""Writers of graph files, for round trips and exchange. Vertices are 0 to n - 1; files count from 1.

Text is written by Spark, in parts whose names are in the order of their lines. Readers take a folder of them for a file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.connectivity import Graph
from weftgraph.plans.lineage import cut, ship


def _lines(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)


def write_adjacency(graph: Graph, path: str, parts: list[int] | None = None) -> None:
    """Adjacency text of the symmetric edges; with ``parts``, the sizes of the parts, those lines are put first."""
    spark = graph.edges.sparkSession
    near = graph.edges.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: (x + 1).cast("string")), " ").alias("near"))
    body = graph.vertices.join(near, graph.vertices["v"] == near["src"], "left").select(F.col("v").alias("key"), F.coalesce("near", F.lit("")).alias("value"))
    n, m = graph.vertices.count(), graph.edges.count() // 2
    head = [f"{n} {m}" + (f" {len(parts)}" if parts else ""), *map(str, parts or [])]
    top = spark.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "key long, value string")
    ordered = top.unionByName(body).repartitionByRange("key").sortWithinPartitions("key")
    _lines(ordered, path)


def write_edge_list(edges: DataFrame, n: int, path: str) -> None:
    """Edge text, one line for each row of ``edges``, by source."""
    m = edges.count()
    spark = edges.sparkSession
    top = spark.createDataFrame([(-1, -1, f"p {n} {m}")], "src long, dst long, value string")
    body = edges.select("src", "dst", F.concat(F.lit("e "), (F.col("src") + 1).cast("string"), F.lit(" "), (F.col("dst") + 1).cast("string")).alias("value"))
    _lines(top.unionByName(body).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst"), path)


def write_edge_list_parts(edges: DataFrame, n: int, parts: int, path: str) -> None:
    """Folders ``<path>_0, ...`` of edge text, sources dealt out by ranges."""
    step = -(-n // parts)
    for k in range(parts):
        own = edges.where((F.col("src") >= k * step) & (F.col("src") < (k + 1) * step))
        write_edge_list(own.coalesce(1), n, f"{path}_{k}")


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = np.column_stack([batch.column(k).to_numpy() for k in (0, 1)]).astype(np.uint64) + np.uint64(1)
        yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary())], ["records"])


def write_binary(edges: DataFrame, n: int, path: str) -> None:
    """One file of records, on any file system that Spark knows. Executors make the records, a batch of edges at a time; the
    driver puts the batches into the file one after another, since a file has one writer."""
    spark = edges.sparkSession
    ship(spark)
    rows = cut(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(_records, "records binary"))
    m = edges.count()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    try:
        out.write(bytearray(np.array([n, m], np.uint64).tobytes()))
        for row in rows.toLocalIterator():
            out.write(bytearray(row["records"]))
    finally:
        out.close()
