"""What files hold: a digest and a kind of each, without a task that reads the whole of a large file.

A small file is hashed as one row.  A large one is read as lines (whatever lies between line feeds), whose SHA-256 are the coefficients of a polynomial; each task works out its block's, and blocks are
put together in order, so the digest doesn't depend on where Spark cuts.  Lines and length together tell the content, as they leave open only whether a last line feed or a byte order mark is there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celldag.functions.cells import container_kind

WHOLE = 64 << 20  # bytes of a file that is hashed as one row
HEAD = 16  # bytes that tell the kind
#: Names of which Spark's reader of lines unpacks the content; such files are read as one row whatever their length.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd", ".passthrough")
PRIME = 2**521 - 1
BASE = int.from_bytes(hashlib.sha512(b"celldag").digest())
BLOCK = "file long, start long, lines long, bytes long, value binary, head binary"


def _blocks(batches):
    """A row for each block of a file: its number of lines, the value of their polynomial, the first bytes of the file's first block."""
    at, lines, size, value, head = None, 0, 0, 0, b""

    def row():
        return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "lines": lines, "bytes": size, "value": value.to_bytes(66), "head": head[:HEAD]}], schema=pa.schema([("file", pa.int64()), ("start", pa.int64()), ("lines", pa.int64()), ("bytes", pa.int64()), ("value", pa.binary()), ("head", pa.binary())]))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        file, start, bytes_of = (batch.column(c).to_numpy() for c in ("file", "start", "bytes"))
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
            if (here := (int(file[a]), int(start[a]))) != at:
                if at is not None:
                    yield row()
                at, lines, size, value, head = here, 0, 0, 0, b""
            for digest in batch.column("digest").slice(a, b - a).to_pylist():
                value = (value * BASE + int.from_bytes(digest)) % PRIME
            lines += b - a
            size += int(bytes_of[a:b].sum())
            for i in range(a, b):
                if start[a] != 0 or len(head) >= HEAD:
                    break
                head += batch.column("head")[i].as_py() + b"\n"
    if at is not None:
        yield row()


def _joined(t: pa.Table) -> pa.Table:
    """A file's blocks (a row each) as one: its polynomial's hash and its first bytes."""
    rows = sorted(t.to_pylist(), key=lambda r: r["start"])
    lines = value = 0
    for r in rows:
        value = (value * pow(BASE, r["lines"], PRIME) + int.from_bytes(r["value"])) % PRIME
        lines += r["lines"]
    return pa.table({"file": pa.array([rows[0]["file"]], pa.int64()), "bytes": pa.array([sum(r["bytes"] for r in rows)], pa.int64()), "digest": pa.array([hashlib.sha256(b"%d:%d" % (lines, value)).hexdigest()], pa.string()), "head": pa.array([rows[0]["head"]], pa.binary())})


def _file():
    return F.xxhash64("_metadata.file_path").alias("file")


def line_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, bytes, digest, head) of each file, read in blocks; bytes: those of its lines, each with a line feed."""
    lines = spark.read.format("text").option("lineSep", "\n").option("ignoreMissingFiles", "true").load(paths)
    start, raw = F.col("_metadata.file_block_start"), F.col("value").cast("binary")
    sent = lines.select(_file(), start.alias("start"), (F.octet_length("value").cast("long") + 1).alias("bytes"), F.unhex(F.sha2(raw, 256)).alias("digest"), F.when(start == 0, F.substring(raw, 1, HEAD)).alias("head"))
    return sent.mapInArrow(_blocks, BLOCK).groupBy("file").applyInArrow(_joined, "file long, bytes long, digest string, head binary")


def contents(spark: SparkSession, paths: list[str], magics: dict[str, str] | None = None) -> DataFrame:
    """(path, name, length, modified, sha256, kind, content) of these files; missing ones are passed over.

    sha256 is that of the content up to WHOLE bytes and for PACKED names, else that of length and line digest.  The content is read where it is used.
    """
    return described(_named(spark, paths), magics)


def _named(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)


def whole(files: DataFrame, magics: dict[str, str] | None = None) -> DataFrame:
    """The same of binary files, each hashed as one row."""
    return files.select(*facts(), F.sha2("content", 256).alias("sha256"), container_kind(F.col("content"), magics).alias("kind"), "content")


def facts() -> list:
    """What a listing says of a file."""
    return ["path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified")]


def described(files: DataFrame, magics: dict[str, str] | None = None) -> DataFrame:
    """The same of a table of binary files (not a stream), whose large ones are told by their names."""
    spark = files.sparkSession
    large = [r["path"] for r in files.where(F.col("length") > WHOLE).select("path").collect()]  # some of the paths
    found = whole(files.where(F.col("length") <= WHOLE), magics)  # the reader passes over the others
    packed = [p for p in large if p.lower().endswith(PACKED)]
    plain = [p for p in large if not p.lower().endswith(PACKED)]
    if packed:
        found = found.unionByName(whole(_named(spark, packed).where(F.col("length") > WHOLE), magics))
    if plain:
        head = F.when(F.col("length") - F.col("bytes") >= 2, F.concat(F.unhex(F.lit("EFBBBF")), F.col("head"))).otherwise(F.col("head"))  # the reader of lines takes the mark away
        told = _named(spark, plain).where(F.col("length") > WHOLE).select(*facts(), _file(), "content").join(F.broadcast(line_digests(spark, plain)), "file")
        found = found.unionByName(told.select("path", "name", "length", "modified", F.sha2(F.concat_ws(":", "length", "digest"), 256).alias("sha256"), container_kind(head, magics).alias("kind"), "content"))
    return found
