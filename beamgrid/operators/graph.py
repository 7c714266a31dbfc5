"""Connected components over edges, and tables that cut the lineage of loops."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df, written once in the folder that spark.checkpoint.dir names and read back: later steps start from a short plan with true sizes.

    Without that setting a single machine uses a temporary folder; on a cluster, where no such folder is shared, it is an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local()
    path = f"{root.rstrip('/')}/beamgrid-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_path(spark: SparkSession, name: str) -> str:
    """A new path for one file that the driver writes and tasks read: in the shared folder if that is a plain path, else in a temporary one."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    folder = f"{root if root.startswith('/') else _local()}/beamgrid-file-{uuid.uuid4().hex}"
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder}/{name}"


_folders: list[str] = []


def _local() -> str:
    if not _folders:
        _folders.append(tempfile.mkdtemp(prefix="beamgrid-"))
        atexit.register(shutil.rmtree, _folders[0], ignore_errors=True)
    return _folders[0]


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for the nodes of edges (a, b). Large and small stars take turns until nothing changes."""
    e = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = kept(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = kept(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
