"""Signatures from changes equal those worked out anew, whatever the rows."""

import random

from celldag.operators import signatures
from celldag.plans.project import Project, data_signature

ROWS = "doc string, a long, b string"
KEYS, COLUMNS = ["doc"], ["a", "b"]


def state(df):
    return {r["doc"]: (r["n"], tuple(r["lanes"])) for r in df.collect()}


def test_updates_equal_sums_of_all_rows(spark):
    rng = random.Random(6)
    row = lambda: (rng.choice(["d1", "d2", "d3", None]), rng.choice([None, 1, 2, 3]), rng.choice([None, "", "x", "1:x", "é"]))
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    held = [row() for _ in range(200)]
    kept = signatures.sums(frame(held), KEYS, COLUMNS)
    for _ in range(3):
        gone = [held.pop(rng.randrange(len(held))) for _ in range(40)]
        come = [row() for _ in range(25)] + [("new", 1, "x")]
        held += come
        after = signatures.update(kept, frame(come), frame(gone), KEYS, COLUMNS).collect()
        kept = spark.createDataFrame(after, "doc string, n long, lanes array<long>")
        assert state(kept) == state(signatures.sums(frame(held), KEYS, COLUMNS))
    last = [r for r in held if r[0] == "new"]
    assert "new" not in state(signatures.update(kept, frame([]), frame(last), KEYS, COLUMNS))


def test_order_does_not_count_but_repeats_and_borders_do(spark):
    one = lambda rows: signatures.overall(signatures.sums(spark.createDataFrame(rows, ROWS), KEYS, COLUMNS), KEYS).first()["signature"]
    base = one([("d", 1, "x"), ("d", 2, "y")])
    assert base == one([("d", 2, "y"), ("d", 1, "x")])
    others = [one([("d", 1, "x"), ("d", 1, "x"), ("d", 2, "y")]), one([("d", 1, "y"), ("d", 2, "x")]), one([("d", 1, "x"), ("e", 2, "y")]), one([("d", 12, ""), ("d", None, "y")]), one([])]
    assert len({base, *others}) == 6 and others[-1] == "0" * 64


def test_changes_and_the_projects_signature(spark):
    sums = lambda rows: signatures.sums(spark.createDataFrame(rows, ROWS), KEYS, COLUMNS)
    old, new = sums([("a", 1, "x"), ("b", 1, "x"), (None, 1, "x")]), sums([("a", 1, "x"), ("b", 1, None), ("c", 1, "x"), (None, 1, "x")])
    assert {r["doc"]: r["state"] for r in signatures.changes(old, new, KEYS).collect()} == {"a": "same", "b": "changed", "c": "added", None: "same"}
    project = Project("p", [{"name": "f"}])
    assert data_signature(project, old, KEYS, "2") == data_signature(project, old, KEYS, "2") != data_signature(project, new, KEYS, "2")
    assert data_signature(project, old, KEYS, "2") != data_signature(project, old, KEYS, "3")
