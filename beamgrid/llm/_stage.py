"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set (tests, a single machine)."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="beamgrid-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


#: Tables that drop() can remove, by the identity of their DataFrame (which is held, so that the identity stays its own).
_tables: dict[int, tuple[DataFrame, str]] = {}


class Own:
    """A caller's table under column names that operators don't use (own0, own1, ...), so that none of its columns can clash with theirs."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.df = df.toDF(*[f"own{k}" for k in range(len(self.names))])

    def of(self, name: str) -> str:
        """The name that the caller's column has here; names differ in more than case, as in Spark."""
        return f"own{[x.lower() for x in self.names].index(name.lower())}"

    def back(self, *but: str) -> list[Column]:
        """The caller's columns under their own names, without those named in but."""
        gone = {x.lower() for x in but}
        return [F.col(f"own{k}").alias(x) for k, x in enumerate(self.names) if x.lower() not in gone]


#: Rows (of a few short columns) that may be broadcast, and rows of marked(), which stand for 64 each.
BROADCAST_ROWS, BROADCAST_MARKS = 10_000, 500_000


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, which is kept already, marked for a broadcast if it has few rows; else left to a join by shuffle."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def marked(df: DataFrame, rows: DataFrame, row: str = "row", times: str | None = None) -> DataFrame:
    """The rows of df (numbered into `row`) that rows, a table with that column, names; with `times`, a column of rows from 1 to 3.

    Places go as bits, 64 in a word, so that texts stay where they are: a few MB of words are broadcast for 30 million rows.
    """
    n = F.lit(1) if times is None else F.col(times)
    at = F.col(f"{row}.at")
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    bits = lambda k: F.bit_or(F.call_function("shiftleft", F.shiftright(n, k).bitwiseAND(F.lit(1)).cast("long"), bit))
    words = stored(rows.groupBy(F.col(f"{row}.file").alias("in_file"), word.alias("in_word")).agg(bits(0).alias("ones"), bits(1).alias("twos")), "marks")
    met = df.join(bounded(words, BROADCAST_MARKS), (F.col(f"{row}.file") == F.col("in_file")) & (word == F.col("in_word")))
    count = (F.bit_get("ones", bit) + F.bit_get("twos", bit) * 2).cast("long")
    out = met.where(count > 0)
    return out.select(*df.columns) if times is None else out.select(*df.columns, count.alias(times))


def frozen(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a reliable checkpoint; meant for narrow rows."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/beamgrid-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: Rows of whole texts that go to a Python worker at once; a task holds some copies of them, in the JVM's direct memory and in Python.
TEXTS_AT_ONCE = 1_000


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """For steps that run within: Arrow batches of TEXTS_AT_ONCE rows at most."""
    before = small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def small_batches(spark: SparkSession) -> str:
    """The same from now on, for steps that run when their result is written. Gives the former setting."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= TEXTS_AT_ONCE:
        spark.conf.set(_BATCH, str(TEXTS_AT_ONCE))
    return before


def drop(df: DataFrame) -> None:
    """Removes the table that stored() gave, once nothing will read it again."""
    path = _tables.pop(id(df), (None, None))[1]
    if path:
        _remove(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffles and checkpoints that nothing refers to, which it does when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _is_scan(df: DataFrame) -> bool:
    """Whether df is one file scan under projections and filters, whose rows have a place in a file."""
    try:
        plan = df._jdf.queryExecution().analyzed()
        while plan.children().size():
            if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias") or not plan.deterministic():
                return False
            plan = plan.children().apply(0)
        return plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation")
    except AttributeError:  # another kind of session
        return False


def numbered(df: DataFrame, into: str, name: str = "numbered") -> DataFrame:
    """df with a struct `into` that tells its rows apart and stays the same whenever it is computed again.

    Rows of one Parquet scan have their file (a 64-bit hash of its path) and place in it, and df is read again where it is used again;
    any other df is stored first.
    """
    if _is_scan(df):
        try:
            return df.withColumn(into, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
        except AnalysisException:  # a format without row places
            pass
    return stored(df.withColumn(into, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), name)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may be gone already; the folder is the cluster's scratch space
        pass


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read back: columns prune, rows keep still."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[id(out)] = out, path
    return out
