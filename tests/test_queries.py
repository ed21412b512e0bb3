"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import pytest

from celldag.catalogue import ORACLES, QUERIES
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def test_each_query_has_a_name_of_its_own():
    from celldag.queries import builds, concepts, curation, dag, recipes, records, regions, relational

    assert len(QUERIES) == sum(len(m.QUERIES) for m in (builds, concepts, curation, dag, recipes, records, regions, relational))
    assert set(ORACLES) <= set(QUERIES)


def test_stream_reads_each_file_once(spark, sf_dir):
    rows = QUERIES["stream_file_events"](spark, sf_dir).collect()
    assert len(rows) == 14 and len({r["name"] for r in rows}) == 14


def test_files_that_wait_are_read_in_a_later_run(spark, tmp_path):
    import os
    import time

    from celldag.streaming import files

    folder, log, seen = tmp_path / "in", f"{tmp_path}/log", []
    folder.mkdir()
    old, fresh, odd = folder / "old.zip", folder / "fresh.zip", folder / "odd.bin"
    for f, head in ((old, b"PK\x03\x04old"), (fresh, b"PK\x03\x04fresh"), (odd, b"half")):
        f.write_bytes(head)
    os.utime(old, (time.time() - 999, time.time() - 999))

    def run():
        stream = files.new_contents(files.watch(spark, str(folder)))
        files.ingest(stream, log, f"{tmp_path}/checkpoint", lambda df: seen.extend(r["name"] for r in df.collect()), settle="100 seconds").awaitTermination()

    run()
    assert seen == ["old.zip"]
    for f in (fresh, odd):
        os.utime(f, (time.time() - 200, time.time() - 200))
    run()
    assert seen == ["old.zip", "fresh.zip"]
    odd.write_bytes(b"PK\x03\x04whole now")
    os.utime(odd, (time.time() - 200, time.time() - 200))
    run()
    run()
    assert seen == ["old.zip", "fresh.zip", "odd.bin"] and spark.read.parquet(log).count() == 3


def test_no_file_is_lost_for_its_age_and_notes_do_not_grow(spark, tmp_path):
    import os
    import time

    from celldag.streaming import files

    folder, log, seen = tmp_path / "in", f"{tmp_path}/log", []
    folder.mkdir()

    def put(name, content, age):
        (folder / name).write_bytes(content)
        os.utime(folder / name, (time.time() - age, time.time() - age))

    def run():
        stream = files.new_contents(files.watch(spark, str(folder)))
        files.ingest(stream, log, f"{tmp_path}/checkpoint", lambda df: seen.extend(r["name"] for r in df.collect())).awaitTermination()

    put("new.zip", b"PK\x03\x04new", 5)
    put("odd.bin", b"half", 5)
    run()
    put("old.zip", b"PK\x03\x04old", 30 * 86400)
    put("newer.zip", b"PK\x03\x04newer", 5)
    run()
    run()
    assert sorted(seen) == ["new.zip", "newer.zip", "old.zip"]
    assert [r["path"][-7:] for r in spark.read.parquet(f"{log}_waiting").collect()] == ["odd.bin"]
    put("odd.bin", b"PK\x03\x04odd", 5)
    run()
    run()
    assert seen[3:] == ["odd.bin"] and not os.path.exists(f"{log}_waiting") or spark.read.schema("path string").parquet(f"{log}_waiting").count() == 0


def test_scan_and_watch_see_the_whole_folder(spark, sf_dir, tmp_path):
    import hashlib
    import os

    from celldag.streaming import files

    listed = {(f, hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest()) for d, _, fs in os.walk(sf_dir) for f in fs}
    assert len(listed) == 14 and {(r["name"], r["sha256"]) for r in files.scan(spark, sf_dir).collect()} == listed
    seen = files.new_contents(files.watch(spark, sf_dir, magics={"50415231": "parquet"}))
    files.ingest(seen, f"{tmp_path}/log", f"{tmp_path}/checkpoint", lambda df: None).awaitTermination()
    assert {(r["path"].rsplit("/", 1)[-1], r["sha256"]) for r in spark.read.parquet(f"{tmp_path}/log").collect()} == listed


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
