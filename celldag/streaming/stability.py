"""Files that are still being written: released once two scans of the folder in a row find them unchanged.

A scan is a listing, appended to a folder of scans that a stream reads; the stream keeps, for every path, what the last
scan said.  So a change of a file is an event like its coming, whatever times the file itself claims, and a
run that is killed goes on from its checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from celldag.sources.packages import _path, exists
from celldag.streaming.contents import contents

SCAN = "scan long, path string, length long, modified timestamp, present boolean"
EVENT = "kind string, path string, length long, modified timestamp"
LOG = "path string, sha256 string, parser string, status string, message string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AT_ONCE = 10_000  # paths that one read names


def take_scan(spark: SparkSession, folder: str, scans: str, pattern: str = "*") -> None:
    """Append a listing of the folder: a row per file, and one (present: false) per file of an earlier scan that is gone.

    Contents are not read.  Names that begin with ~$ are lock files of open documents and don't count.  The paths of this scan are written before its rows, and those of earlier
    scans removed after, so a scan that is cut off at any point is made up for by the next one.
    """
    number, known = time.time_ns(), f"{scans}/known"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    here = files.select("path", "length", F.col("modificationTime").alias("modified")).where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).persist()
    try:
        rows = here.select(F.lit(number).alias("scan"), "path", "length", "modified", F.lit(True).alias("present"))
        earlier = []
        if exists(spark, known):
            at, fs = _path(spark, known)
            earlier = [s.getPath() for s in fs.listStatus(at)]
        here.select("path").write.parquet(f"{known}/{number}")
        if earlier:
            before = spark.read.schema("path string").parquet(*[p.toString() for p in earlier]).distinct()
            gone = before.join(here.select("path"), "path", "left_anti")
            rows = rows.unionByName(gone.select(F.lit(number).alias("scan"), "path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"), F.lit(False).alias("present")))
        rows.write.mode("append").parquet(f"{scans}/rows")
        for p in earlier:
            fs.delete(p, True)
    finally:
        here.unpersist()


class _Stable(StatefulProcessor):
    """Per path: what the last scan said, for how many scans, and what was released last."""

    def __init__(self, required: int):
        self.required = required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "length long, modified long, times int, out_length long, out_modified long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        out = []
        scans = pd.concat(list(rows)).sort_values("scan")  # of one path: a row for each scan that waits
        length, modified, times, out_length, out_modified = self.state.get() if self.state.exists() else (None, None, 0, None, None)
        for r in scans.itertuples():
            if not r.present:
                if out_length is not None:
                    out.append(("deleted", key[0], None, None))
                length, modified, times, out_length, out_modified = None, None, 0, None, None
                continue
            now = (int(r.length), r.modified.value)
            times = times + 1 if now == (length, modified) else 1
            length, modified = now
            if times >= self.required and now != (out_length, out_modified):
                out.append(("created" if out_length is None else "modified", key[0], length, r.modified))
                out_length, out_modified = now
        if length is None:
            self.state.clear()
        else:
            self.state.update((length, modified, min(times, self.required), out_length, out_modified))
        yield pd.DataFrame(out, columns=["kind", "path", "length", "modified"]).astype({"length": "Int64", "modified": "datetime64[ns]"})

    def close(self) -> None:
        pass


def events(spark: SparkSession, scans: str, required: int = 2) -> DataFrame:
    """A stream of (kind, path, length, modified): created, modified and deleted files, the former two once `required` scans in a row agree on length and time.

    The state is a row per file that is in the folder, and goes with it.  Scans are removed when they have been read.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    listed = spark.readStream.schema(SCAN).option("cleanSource", "delete").option("maxFileAge", "100000d").parquet(f"{scans}/rows")
    return listed.groupBy("path").transformWithStateInPandas(_Stable(required), EVENT, "append", "none")


def _handled(spark: SparkSession, paths: list[str], handle: Callable[[DataFrame], None], magics: dict[str, str] | None) -> list[tuple[str, str]]:
    """Runs `handle` on these files; where it fails, on either half of them, so that a failing file keeps no other from being read.  Returns the failing ones and why."""
    try:
        handle(contents(spark, paths, magics))
        return []
    except Exception as e:  # whatever a handler raises is that file's failure
        if len(paths) == 1:
            return [(paths[0], f"{type(e).__name__}: {e}"[:500])]
        half = len(paths) // 2
        return _handled(spark, paths[:half], handle, magics) + _handled(spark, paths[half:], handle, magics)


def latest(spark: SparkSession, log: str) -> DataFrame:
    """The log, or none of it where there isn't one yet."""
    return spark.read.schema(LOG).parquet(log) if exists(spark, log) else spark.createDataFrame([], LOG)


def _ingest_batch(batch: DataFrame, log: str, handle: Callable[[DataFrame], None], parser: str, magics: dict[str, str] | None) -> None:
    spark = batch.sparkSession
    came = batch.where("kind <> 'deleted'").select("path", "length", "modified").distinct().persist()
    chunk: list[str] = []

    def take() -> None:
        there = [p for p in chunk if exists(spark, p)]
        if not there:
            return
        seen = contents(spark, there, magics).drop("content")
        # A file that has changed since its release is released again by a later scan.
        seen = seen.join(came.withColumnsRenamed({"length": "l", "modified": "m"}), "path").where("length = l and modified = m").persist()
        done = latest(spark, log).where((F.col("parser") == parser) & (F.col("status") != "WAITING")).select("sha256").distinct()
        fresh = seen.join(done, "sha256", "left_anti")
        first = fresh.where("kind <> 'unknown'").groupBy("sha256").agg(F.min("path").alias("path")).collect()  # of equal contents one is read; at most AT_ONCE
        failed = dict(_handled(spark, sorted(r["path"] for r in first), handle, magics)) if first else {}
        told = spark.createDataFrame([(r["path"], "FAILED" if r["path"] in failed else "SUCCESS", failed.get(r["path"])) for r in first], "path string, status string, message string")
        status = F.when(F.col("kind") == "unknown", "WAITING").otherwise(F.coalesce("status", F.lit("DUPLICATE")))
        rows = seen.join(told, "path", "left").withColumn("status", status).select("path", "sha256", F.lit(parser).alias("parser"), "status", "message")
        # A batch that runs again after a failure finds its rows there.
        rows.join(latest(spark, log), ["path", "sha256", "parser"], "left_anti").write.mode("append").parquet(log)
        seen.unpersist()

    for r in came.orderBy("path").toLocalIterator():
        chunk.append(r["path"])
        if len(chunk) == AT_ONCE:
            take()
            chunk.clear()
    if chunk:
        take()
    came.unpersist()


def ingest(stream: DataFrame, log: str, checkpoint: str, handle: Callable[[DataFrame], None], parser: str = "1", magics: dict[str, str] | None = None) -> StreamingQuery:
    """Run `handle` on the files (with path, name, length, modified, sha256, kind, content) of created and modified events, and log each: SUCCESS, FAILED with why, DUPLICATE (its content was
    read before), WAITING (no known kind of container, as while locked; it comes again when it changes).

    `handle` gets many files at once, and after a failure some of them again, so it should tell them by path and sha256.  Ends when all
    scans so far are read.
    """
    return stream.writeStream.foreachBatch(lambda df, number: _ingest_batch(df, log, handle, parser, magics)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_once(spark: SparkSession, folder: str, state: str, handle: Callable[[DataFrame], None], pattern: str = "*", parser: str = "1", magics: dict[str, str] | None = None, required: int = 2) -> None:
    """One scan of the folder and all that follows from it; to be called again and again.  `state`: a folder for scans, log and checkpoint."""
    take_scan(spark, folder, f"{state}/scans", pattern)
    ingest(events(spark, f"{state}/scans", required), f"{state}/log", f"{state}/checkpoint", handle, parser, magics).awaitTermination()
