"""Session-level plumbing shared by every operator: shared storage, staging, sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own (tests);
    on a cluster a missing setting is an error, since a machine-local folder
    would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"skeinworks-{os.getpid()}")
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


class Stage:
    """Writes intermediate tables to the shared folder and drops them when told.

    A staged table cuts lineage: a lost executor costs only the tasks that read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_stage_path"] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for f in frames:
            path = f.__dict__.get("_stage_path") if f is not None else None
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Projects ``df`` to the given columns, renamed: ``pick(df, id='doc_id')``.

    Operators start with it, so extra columns with clashing names never reach a join.
    """
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """Rows of ``df`` if there are at most ``limit`` of them, else ``None``.

    The check reads at most ``limit + 1`` rows, so it is safe on any size.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
