"""What the operators share: words, column names, and from the library code on the workers and cuts in the lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans import lineage
from weftgraph.plans.lineage import cut

__all__ = ["NOT_SPACE", "SPACE", "cut", "fresh", "kept", "read", "ship", "spread", "tidy", "words_of"]

#: The characters that separate words, as a class for Java's and Python's expressions.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Bytes of a batch that goes to a Python worker, about. Spark's own bound is eight times that; as strings and numbers of Python a
#: batch takes several times its bytes, in each core's worker.
BATCH_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers. A session in which no bound of batches' bytes is set gets BATCH_BYTES."""
    lineage.ship(spark)
    if _BYTES not in spark.conf.getAll:
        spark.conf.set(_BYTES, BATCH_BYTES)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use, in any case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def tidy() -> None:
    """Give what a worker has freed back to the machine; Arrow and the C library keep it else, and workers are used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What a worker has made under this name. Workers serve one operator after another; what those before kept is dropped."""
    if name not in _kept:
        _kept.clear()
        tidy()
        _kept[name] = make()
    return _kept[name]


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few files, dealt out to all cores; a scan with splits for all of them stays as it is.

    Only for plain scans: of another plan, finding the number of partitions could run part of it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
