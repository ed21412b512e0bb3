"""Watching a folder of cell files as a stream: stable files only, each content once, in bounded runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from celldag.functions.cells import stable_id
from celldag.sources.packages import _path, exists
from celldag.streaming import contents

#: The files that a folder scan sees; names that begin with ~$ are lock files of open documents.
FILES = "path string, modificationTime timestamp, length long, content binary"

#: The source passes over files that are older than the newest by more than this: a week, unless told otherwise.
NEVER = "100000d"


def scan(spark: SparkSession, folder: str, pattern: str = "*", magics: dict[str, str] | None = None) -> DataFrame:
    """All files now: path, name, length, modified, sha256 and container kind; lock files left out.

    A file beyond contents.WHOLE bytes is read in blocks, and its sha256 is that of `contents`.  magics: first bytes (hex) of the
    container kinds to tell, instead of the usual ones.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return contents.described(_open(files), magics).drop("content")


def watch(spark: SparkSession, folder: str, pattern: str = "*", magics: dict[str, str] | None = None) -> DataFrame:
    """The same as a stream of new files; of those beyond contents.WHOLE bytes sha256 and kind are null, and `ingest` works them out.

    The source offers a file once, so a file that is still being written must not be dropped here: `ingest` keeps it for later.
    """
    new = lambda: _open(spark.readStream.format("binaryFile").schema(FILES).option("maxFileAge", NEVER).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))
    none = F.lit(None).cast("string")
    large = new().where(F.col("length") > contents.WHOLE).select(*contents.facts(), none.alias("sha256"), none.alias("kind"))
    return contents.whole(new().where(F.col("length") <= contents.WHOLE), magics).drop("content").unionByName(large)


def _open(files: DataFrame) -> DataFrame:
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def new_contents(files: DataFrame) -> DataFrame:
    """Of a stream of files, each content once, whatever times the files bear; the state is a hash for each content.

    A large file, whose hash isn't known yet, counts as new with each length and time; `ingest` tells whether its content is.
    """
    known = F.coalesce("sha256", F.concat_ws("|", "path", "length", "modified"))
    return files.withColumn("sha256", known).dropDuplicates(["sha256"]).withColumn("sha256", F.when(F.col("kind").isNotNull(), F.col("sha256")))


LOG = "file_id string, path string, sha256 string, parser string"
WAITING = "path string"
PATHS_AT_ONCE = 10_000


def _hashed(rows: DataFrame, log: str, parser: str, magics: dict[str, str] | None) -> DataFrame:
    """A batch's rows with the large files' hashes and kinds, as they are now; of these, each content once, and none that the log has."""
    spark, large = rows.sparkSession, rows.where("kind is null")
    paths = [r["path"] for r in large.select("path").distinct().collect()]  # a batch's
    if not paths:
        return rows
    told = contents.contents(spark, paths, magics).select(*rows.columns).persist()
    new = told.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in told.columns if c != "sha256"]), "path").alias("f")).select("f.*", "sha256")
    if exists(spark, log):
        new = new.join(spark.read.schema(LOG).parquet(log).where(F.col("parser") == parser).select("sha256"), "sha256", "left_anti")
    return rows.where("kind is not null").unionByName(new.select(*rows.columns))


def _take(rows: DataFrame, log: str, handle: Callable[[DataFrame], None], parser: str, settle: str, waiting: str, magics: dict[str, str] | None = None) -> None:
    """Handle and log the files that are ready and not in the log; append the paths of the others to `waiting`."""
    spark, batch = rows.sparkSession, rows.persist()
    rows = _hashed(batch, log, parser, magics)
    rows = rows.withColumn("file_id", stable_id(F.col("path"), F.col("sha256"), F.lit(parser))).dropDuplicates(["file_id"])
    if exists(spark, log):
        rows = rows.join(spark.read.schema(LOG).parquet(log).select("file_id"), "file_id", "left_anti")
    ready = (F.col("kind") != "unknown") & (F.col("modified") <= F.current_timestamp() - F.expr(f"interval {settle}"))
    rows = rows.withColumn("ready", ready).persist()
    taken = rows.where("ready").drop("ready")
    handle(taken)
    taken.select("file_id", "path", "sha256", F.lit(parser).alias("parser")).write.mode("append").parquet(log)
    rows.where("not ready").select("path").write.mode("append").parquet(waiting)
    rows.unpersist()
    batch.unpersist()


def _replace(spark: SparkSession, old: str, new: str) -> None:
    at, fs = _path(spark, old)
    fs.delete(at, True)
    fs.rename(_path(spark, new)[0], at)


def ingest_waiting(spark: SparkSession, log: str, handle: Callable[[DataFrame], None], parser: str = "1", settle: str = "0 seconds", magics: dict[str, str] | None = None) -> None:
    """Read the files again that earlier runs found unsettled or of no known kind; those that are ready now are handled and logged.

    The notes of what still waits replace those of before, so a file has one; one that is gone by now, or of equal content with one that
    was handled here, is forgotten.  Which noted files are there is found by listing their folders; paths are named to Spark's reader PATHS_AT_ONCE at a time.
    """
    notes, following = f"{log}_waiting", f"{log}_waiting_next"
    if not exists(spark, notes):
        if not exists(spark, following):
            return
        _replace(spark, notes, following)  # a run ended between the two steps below
    fs = _path(spark, following)[1]
    fs.delete(_path(spark, following)[0], True)
    noted = spark.read.schema(WAITING).parquet(notes).distinct()
    folders = [r["d"] for r in noted.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("d")).distinct().collect() if exists(spark, r["d"])]
    part: list[str] = []

    def again() -> None:
        seen = contents.contents(spark, part, magics).drop("content")
        first = seen.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in seen.columns if c != "sha256"]), F.struct("modified", "path")).alias("f")).select("f.*", "sha256")
        _take(first.select(*seen.columns), log, handle, parser, settle, following)

    if folders:
        listed = spark.read.format("binaryFile").load(folders).select("path")
        for row in noted.join(listed, "path", "left_semi").toLocalIterator():
            part.append(row["path"])
            if len(part) == PATHS_AT_ONCE:
                again()
                part.clear()
        if part:
            again()
    if exists(spark, following):
        _replace(spark, notes, following)
    else:
        fs.delete(_path(spark, notes)[0], True)


def ingest(files: DataFrame, log: str, checkpoint: str, handle: Callable[[DataFrame], None], parser: str = "1", settle: str = "0 seconds", magics: dict[str, str] | None = None) -> StreamingQuery:
    """Run `handle` on files that this parser version hasn't read, and note them in the Parquet log; ends when all are done.

    A batch that is run again after a failure finds its files in the log and skips them.  A file that was written to within `settle`, or that
    is of no known container kind (locked, or unfinished), is noted in <log>_waiting; each run begins with those.  So no
    file is lost, though the stream offers each only once.
    """
    ingest_waiting(files.sparkSession, log, handle, parser, settle, magics)
    return files.writeStream.foreachBatch(lambda df, number: _take(df, log, handle, parser, settle, f"{log}_waiting", magics)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
