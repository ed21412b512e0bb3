"""Tables that are folders of files."""

import os
import shutil

import pytest

from celldag.catalogue import QUERIES


@pytest.mark.parametrize("query", ["scan_files", "stream_file_events"])
def test_a_table_in_several_files_is_one(query, spark, sf_dir, tmp_path):
    names = ["region.parquet", "nation.parquet"]
    for name in names:
        os.mkdir(tmp_path / name)
        shutil.copy(f"{sf_dir}/{name}", tmp_path / name / "part-0.parquet")
        spark.read.parquet(f"{sf_dir}/{name}").limit(2).coalesce(1).write.parquet(f"{tmp_path}/out-{name[:-8]}")
        part = next(f for f in os.listdir(f"{tmp_path}/out-{name[:-8]}") if f.endswith(".parquet"))
        shutil.move(f"{tmp_path}/out-{name[:-8]}/{part}", tmp_path / name / "part-1.parquet")
        shutil.rmtree(f"{tmp_path}/out-{name[:-8]}")
    assert sorted(tuple(r) for r in QUERIES[query](spark, str(tmp_path)).collect()) == [(n, "parquet") for n in sorted(names)]


@pytest.mark.parametrize("query", ["scan_files", "stream_file_events"])
def test_large_files_are_not_read_as_one_row(query, spark, sf_dir, monkeypatch):
    from celldag.streaming import contents

    monkeypatch.setattr(contents, "WHOLE", 1000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # no larger file can be read as one row
    try:
        assert {r["kind"] for r in QUERIES[query](spark, sf_dir).collect()} == {"parquet"} and QUERIES[query](spark, sf_dir).count() == 14
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_large_files_wait_and_each_content_is_taken_once(spark, tmp_path, monkeypatch):
    import time

    from celldag.streaming import contents, files

    monkeypatch.setattr(contents, "WHOLE", 10)
    folder, log, seen = tmp_path / "in", f"{tmp_path}/log", []
    folder.mkdir()

    def put(name, content, age):
        (folder / name).write_bytes(content)
        os.utime(folder / name, (time.time() - age, time.time() - age))

    def run():
        stream = files.new_contents(files.watch(spark, str(folder)))
        files.ingest(stream, log, f"{tmp_path}/checkpoint", lambda df: seen.extend((r["name"], len(r["sha256"])) for r in df.collect()), settle="100 seconds").awaitTermination()

    large = b"PK\x03\x04" + b"large\n" * 9
    for name, content, age in (("a.zip", large, 999), ("b.zip", large, 999), ("fresh.zip", large + b"more", 5), ("odd.bin", b"half of it\n" * 9, 999), ("small.zip", b"PK\x03\x04", 999)):
        put(name, content, age)
    run()
    assert sorted(seen) == [("a.zip", 64), ("small.zip", 64)]
    put("c.zip", large, 500)
    put("fresh.zip", large + b"more", 200)
    put("odd.bin", b"PK\x03\x04 whole now" * 9, 200)
    run()
    run()
    assert sorted(seen[2:]) == [("fresh.zip", 64), ("odd.bin", 64)] and spark.read.parquet(log).count() == 4
