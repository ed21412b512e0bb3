"""Files released after two equal scans: whatever their times, after changes, failures and restarts, and against a plain watcher."""

import os
import random

import pytest

from celldag.streaming import contents, stability


def put(folder, name, content, mtime):
    (folder / name).write_bytes(content)
    os.utime(folder / name, (mtime, mtime))


def collected(seen):
    return lambda df: seen.extend((r["name"], bytes(r["content"])) for r in df.collect())


def log_of(spark, state):
    return {(r["path"].rsplit("/", 1)[1], r["status"]) for r in stability.latest(spark, f"{state}/log").collect()}


def test_release_after_two_scans_old_times_changes_and_kinds(spark, tmp_path):
    folder, state, seen = tmp_path / "in", f"{tmp_path}/state", []
    folder.mkdir()
    once = lambda: stability.watch_once(spark, str(folder), state, collected(seen))
    put(folder, "new.zip", b"PK\x03\x04new", 2e9 - 1e9)
    put(folder, "~$new.zip", b"PK\x03\x04lock", 1e9)
    once()
    assert seen == []
    put(folder, "old.zip", b"PK\x03\x04old", 1000)  # copied with its own time, long ago
    put(folder, "grows.zip", b"PK\x03\x04a", 1.5e9)
    put(folder, "locked.bin", b"xxxx", 1.5e9)
    put(folder, "copy.zip", b"PK\x03\x04new", 1.5e9)
    once()
    assert seen == [("new.zip", b"PK\x03\x04new")]
    put(folder, "grows.zip", b"PK\x03\x04ab", 1.5e9)
    once()
    assert sorted(seen[1:]) == [("old.zip", b"PK\x03\x04old")]
    assert log_of(spark, state) == {("new.zip", "SUCCESS"), ("old.zip", "SUCCESS"), ("copy.zip", "DUPLICATE"), ("locked.bin", "WAITING")}
    put(folder, "locked.bin", b"PK\x03\x04open", 1.5e9)
    once()
    put(folder, "new.zip", b"PK\x03\x04new2", 1e9)
    once()
    once()
    once()
    assert sorted(seen[2:]) == [("grows.zip", b"PK\x03\x04ab"), ("locked.bin", b"PK\x03\x04open"), ("new.zip", b"PK\x03\x04new2")]
    rows = stability.latest(spark, f"{state}/log").count()
    once()
    assert stability.latest(spark, f"{state}/log").count() == rows and len(seen) == 5


def test_a_failing_file_keeps_no_other_from_being_read(spark, tmp_path):
    folder, state, seen = tmp_path / "in", f"{tmp_path}/state", []
    folder.mkdir()
    for i in range(9):
        put(folder, f"f{i}.zip", b"PK\x03\x04" + (b"bad" if i == 4 else b"ok%d" % i), 1e9)

    def handle(df):
        rows = df.collect()
        if any(b"bad" in bytes(r["content"]) for r in rows):
            raise ValueError("can't be read")
        seen.extend(r["name"] for r in rows)

    for _ in range(3):
        stability.watch_once(spark, str(folder), state, handle)
    assert sorted(seen) == [f"f{i}.zip" for i in range(9) if i != 4]
    log = stability.latest(spark, f"{state}/log")
    assert [(r["path"][-6:], r["message"]) for r in log.where("status = 'FAILED'").collect()] == [("f4.zip", "ValueError: can't be read")] and log.count() == 9


def test_killed_between_scan_and_log(spark, tmp_path, monkeypatch):
    folder, state, seen = tmp_path / "in", f"{tmp_path}/state", []
    folder.mkdir()
    put(folder, "a.zip", b"PK\x03\x04a", 1e9)
    stability.take_scan(spark, str(folder), f"{state}/scans")
    stability.take_scan(spark, str(folder), f"{state}/scans")

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(stability, "_handled", dies)
        with pytest.raises(Exception, match="killed"):
            stability.ingest(stability.events(spark, f"{state}/scans"), f"{state}/log", f"{state}/checkpoint", collected(seen)).awaitTermination()
    assert stability.latest(spark, f"{state}/log").count() == 0
    stability.watch_once(spark, str(folder), state, collected(seen))
    assert seen == [("a.zip", b"PK\x03\x04a")] and log_of(spark, state) == {("a.zip", "SUCCESS")}


def test_events_equal_a_plain_watcher(spark, tmp_path):
    rng, folder, scans = random.Random(4), tmp_path / "in", f"{tmp_path}/scans"
    folder.mkdir()
    seen, known, stable, wanted, found = {}, {}, {}, [], []
    for step in range(7):
        for name in ("a", "b", "c", "d"):
            what = rng.choice(["keep", "keep", "write", "remove"])
            if what == "write":
                put(folder, name, b"x" * rng.randint(1, 3), 1e9 + rng.randint(0, 1))
            elif what == "remove" and (folder / name).exists():
                (folder / name).unlink()
        now = {p.name: (p.stat().st_size, int(p.stat().st_mtime)) for p in folder.iterdir()}
        for name, sig in now.items():
            stable[name] = stable.get(name, 0) + 1 if seen.get(name) == sig else 1
            seen[name] = sig
            if stable[name] >= 2 and known.get(name) != sig:
                wanted.append((name, "modified" if name in known else "created"))
                known[name] = sig
        for name in set(seen) - set(now):
            if name in known:
                wanted.append((name, "deleted"))
                del known[name]
            del seen[name], stable[name]
        stability.take_scan(spark, str(folder), scans)
        if step in (2, 6):  # several scans wait at times
            query = stability.events(spark, scans).writeStream.foreachBatch(lambda df, n: found.extend((r["path"].rsplit("/", 1)[1], r["kind"]) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination()
    assert wanted and {n: [k for m, k in found if m == n] for n in "abcd"} == {n: [k for m, k in wanted if m == n] for n in "abcd"}


def test_large_files_are_read_in_blocks(spark, tmp_path, monkeypatch):
    folder, state, rng = tmp_path / "in", f"{tmp_path}/state", random.Random(5)
    folder.mkdir()
    a = b"PK\x03\x04" + rng.randbytes(60_000).replace(b"ab", b"\n\n")
    i, j = (a.index(b"\n", k) for k in (10_000, 40_000))
    other = {"tail.zip": a + b"\n", "byte.zip": a[:500] + bytes([a[500] ^ 1]) + a[501:], "moved.zip": a[: i + 1] + a[j + 1 :] + b"\n" + a[i + 1 : j], "mark.zip": b"\xef\xbb\xbf" + a, "none.zip": b"PK\x03\x04" + b"x" * 60_000, "packed.gz": b"PK\x03\x04" + b"y" * 900}
    for name, content in {"a b%20.zip": a, "copy.zip": a, "small.zip": b"PK\x03\x04s", **other}.items():
        put(folder, name, content, 1e9)
    paths = [str(p) for p in folder.glob("*.zip")]
    monkeypatch.setattr(contents, "WHOLE", 1000)
    seen = []
    for size in ("1000b", "7000b", "128m"):  # where Spark cuts says nothing
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append({r["name"]: r["sha256"] for r in contents.contents(spark, paths).collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # no larger file can be read as one row
    try:
        for _ in range(2):
            stability.watch_once(spark, str(folder), state, lambda df: df.select("path", "sha256").collect())
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength"):
            spark.conf.unset(key)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 8 and len(set(seen[0].values())) == 7 and seen[0]["a b%20.zip"] == seen[0]["copy.zip"]
    log = dict(log_of(spark, state))
    assert sorted(log) == sorted(["a b%20.zip", "copy.zip", "small.zip", *other])
    assert {log["a b%20.zip"], log["copy.zip"]} == {"SUCCESS", "DUPLICATE"} and log["mark.zip"] == "WAITING" and all(log[x] == "SUCCESS" for x in ("tail.zip", "byte.zip", "moved.zip", "none.zip", "small.zip", "packed.gz"))
