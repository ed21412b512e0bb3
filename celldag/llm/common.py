"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; always read through Spark, so any store will do."""
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bound what moves between Spark and Python at a time: texts are long, so few rows make a batch.

    A setting that the session has changed already stays.
    """
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)
    return spark


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later, as a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


_kept: dict = {}


def kept(key: str, make):
    """What a worker needs in several tasks of one operator: made once, and kept until a task of another operator begins."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def let_go(key: str | None) -> None:
    """Drop what tasks of other operators have kept in this worker."""
    others = _kept.keys() - {key}
    for k in others:
        del _kept[k]
    if others:
        gc.collect()
        give_back()


def frugal(run, keeps: str | None = None):
    """A function over batches that gives memory back when its task is done.  keeps: the key of what it has `kept`; what others kept goes when it begins."""

    def whole(batches):
        let_go(keeps)
        yield from run(batches)
        gc.collect()
        give_back()

    return whole


def frugal_group(run):
    """The same for a function over the table of one group."""

    def whole(t: pa.Table) -> pa.Table:
        let_go(None)
        out = run(t)
        give_back()
        return out

    return whole


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gets fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset, as on one machine in tests, does a temporary folder stand in.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


#: Whether shuffle files go when a query ends (Spark 4.1); a frame takes it over when it is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    What was shuffled on the way isn't read again, so it goes at once; else it would lie on disk until the driver's collector finds it.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        own = df.select("*")  # a plan that nothing else runs
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return own.checkpoint(eager=True)


def unused(df: DataFrame) -> str:
    """A prefix that none of the columns' names begins with."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def lowest_by_hash(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """At most n ids, those of lowest hash: a sample that is the same in every run."""
    one = df.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    return one.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(n)


def slices(batches, max_bytes: int = 16 << 20):
    """Cut Arrow batches so that no piece holds much more text than max_bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = batch.num_rows
        if batch.nbytes > max_bytes:
            step = max(1, batch.num_rows * max_bytes // batch.nbytes)
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null counts as the empty text."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]
