"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(_PACKAGE)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, else the one that was set on the
    context. Only a local session without either gets a temporary one, which goes with the session's process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, in the shared folder, so that lost executors cost no recomputation.

    The result is a relation of its own. A checkpointed frame as Spark returns it keeps the size that was estimated for its
    plan; over a loop of joins these estimates multiply into numbers of thousands of digits.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(done.sparkSession().internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system its path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Shelf:
    """Frames of one schema, written one by one to a folder that all executors share, and read together.

    What grows step by step is appended; it is not rewritten with every step.
    """

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.steps = spark, schema, []
        self.folder = f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> int:
        """Write ``df`` as the next step; the number of its rows."""
        counted = Observation()
        path = f"{self.folder}/{len(self.steps)}"
        df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.steps.append(path)
        return counted.get["n"]

    def last(self, steps: int = 1) -> DataFrame:
        return self._read(self.steps[-steps:])

    def all(self) -> DataFrame:
        return self._read(self.steps)

    def taken(self) -> DataFrame:
        """All rows as a relation of their own; the folder goes."""
        out = cut(self.all())
        if self.steps:
            remove_folder(self.spark, self.folder)
        return out

    def _read(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
