"""Column functions, plans, graph and matching operators on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from celldag.functions import cells
from celldag.functions.normalize import NormalizeError, load_presets
from celldag.functions.units import Units
from celldag.operators import graph, matching, relational, structure, versioning
from celldag.plans import build
from celldag.plans.assemble import assemble
from celldag.plans.project import Project, ProjectError, chain, reusable
from celldag.sources import readers, writers


def test_numbers_as_text(spark):
    numbers = [180.0, 0.1, 12345678.5, 5e-4, 0.000123, 1e16, -3.0, 0.0, 1e-7, 123456789012.25, 1e7]
    out = spark.createDataFrame([(x,) for x in numbers], "x double").select(cells.fmt_num(F.col("x"))).collect()
    assert [r[0] for r in out] == [str(x) for x in numbers]


def test_addresses_and_formulas(spark):
    df = spark.createDataFrame([("AA$10", "=SUM($A$1:B2)+'My sheet'!C3*D4")], "a string, f string")
    r = df.select(cells.cell_column(F.col("a")), cells.cell_row(F.col("a")), cells.formula_references(F.col("f"))).first()
    assert tuple(r) == (27, 10, ["A1:B2", "'My sheet'!C3", "D4"])


def test_dates_and_hues(spark):
    df = spark.createDataFrame([("2024.1.5", "9:05:00", 45296.5, "FFFF00"), ("x", "x", 1.0, "808080")], "d string, t string, s double, c string")
    a, b = df.select(cells.parse_date(F.col("d")).cast("string"), cells.time_of_day(F.col("t")), cells.serial_datetime(F.col("s")).cast("string"), cells.hue(F.col("c"))).collect()
    assert tuple(a) == ("2024-01-05", "09:05", "2024-01-05 12:00:00", "yellow") and tuple(b) == (None, None, None, "gray")


def test_units_and_presets():
    u = Units.parse()
    assert u.canonical("cP@25℃") == "cP" and u.affine("kg", "℃") is None
    a, b = u.affine("°F", "K")
    assert math.isclose(a * 212 + b, 373.15, abs_tol=1e-6)
    assert load_presets("normalizers: [{id: a, steps: [{op: trim_text}]}]") == {"a": [{"op": "trim_text"}]}
    with pytest.raises(NormalizeError):
        load_presets("normalizers: [{id: a, steps: [{op: trim_text}]}, {id: a, steps: [{op: trim_text}]}]")


def test_projects():
    text = "{name: p, fields: [{name: t, concept: c, unit: K}], sources: {include_nodes: {t: [n]}}, transform: [{op: union}]}"
    p = Project.parse(text)
    assert p.field_units() == {"t": "K"} and p.signature(["b", "a"], "1") == p.signature(["a", "b"], "1") != p.signature(["a"], "1")
    builds = [{"signature": p.signature(["a"], "1"), "finished_at": i, "artifact_exists": i != 3} for i in range(4)]
    assert reusable(p, p.signature(["a"], "1"), builds)["finished_at"] == 2
    for bad in ("{name: 1x, fields: [{name: t}]}", "{name: p, fields: [{name: t}, {name: t}]}", "{name: p, fields: [{name: t}], sources: {include_nodes: {u: []}}}", "{name: p, fields: [{name: t}], transform: [{op: no}]}"):
        with pytest.raises(ProjectError):
            Project.parse(bad)
    assert [s["op"] for s in chain({"a": {"op": "x"}, "b": {"op": "y"}, "c": {"op": "z"}}, [("c", "a"), ("a", "b")])] == ["z", "x", "y"]
    with pytest.raises(ProjectError):
        chain({"a": {}, "b": {}}, [("a", "b"), ("b", "a")])


def test_assembly_aligns_broadcasts_and_traces(spark):
    values = spark.createDataFrame(
        [("p1", 0, "b@0", 1.0, None, "A1"), ("p1", 1, "b@1", 2.0, None, "A2"), ("p1", 2, "b@1", 3.0, None, "A3"), ("p2", 0, "b", None, "label", "B1"), ("p3", 0, None, 7.0, None, "C5")],
        "payload_id string, row_idx bigint, row_key string, value_num double, value_text string, cell_address string",
    )
    selection = spark.createDataFrame([("r", "v", 0, "n1", "p1", "℃", "v1"), ("r", "l", 1, "n2", "p2", None, "v1"), ("s", "v", 0, "n3", "p3", "K", "v1")], "region string, field string, field_pos int, node_id string, payload_id string, unit string, version_id string")
    fr = assemble(selection, values, ["v", "l"])
    rows = {(r[0], r[1], r[2]) for r in fr.df.select("v.num", "l.text", "__ln__v.cell").collect()}
    assert rows == {(1.0, "label", "A1"), (2.0, "label", "A2"), (3.0, "label", "A3"), (7.0, None, "C5")}
    out = build.serialise(fr, ["v", "l"])
    assert sorted(r[0] for r in out.select("_row_id").collect()) == [1, 2, 3, 4]
    edges = build.lineage_edges(out, [])
    assert edges.count() == 7
    row = out.where("v.num = 7").first()["_row_id"]
    nodes = spark.createDataFrame([("n3", "head", "d/s/head", "K", "d1")], "node_id string, node_name string, tree_path string, unit string, document_id string")
    found = build.trace(edges, values, nodes, spark.createDataFrame([("d1", "f.xlsx")], "document_id string, filename string"), row, "v").collect()
    assert [(r["cell_address"], r["node_name"], r["filename"]) for r in found] == [("C5", "head", "f.xlsx")]


def test_roots_by_doubling(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 12)], "child long, parent long")
    nodes = spark.range(12).withColumnRenamed("id", "node")
    for hops in (1, 3, 6, 20):
        got = {r["node"]: (r["root"], r["depth"]) for r in graph.roots(edges, nodes, hops).collect()}
        assert got == {i: (max(0, i - hops), min(i, hops)) for i in range(12)}
    proposed = spark.createDataFrame([(3, 7), (7, 3), (5, 5)], "child long, parent long")
    assert {(r[0], r[1]): r[2] for r in graph.would_cycle(edges, proposed, 16).collect()} == {(3, 7): True, (7, 3): False, (5, 5): True}


def test_vote_ties_and_tiers(spark):
    votes = spark.createDataFrame([("a", "x", False), ("a", "x", False), ("a", "y", True), ("b", "x", False), ("b", "y", False)], "k string, c string, h boolean")
    got = {r["k"]: (r["winner"], r["tier"], r["support"], r["total"], r["dissent"]) for r in relational.two_tier_vote(votes, ["k"], "c", F.col("h")).collect()}
    assert got == {"a": ("y", "human", 1, 1, ""), "b": (None, "auto", 1, 2, "x,y")}


def test_retrieve_and_judge(spark):
    aliases = spark.createDataFrame([("core temperature", "temp"), ("weight", "mass"), ("water weight", "mass")], "alias string, concept string")
    concepts = spark.createDataFrame([("temp", "temperature", "numeric", True), ("mass", "mass", "numeric", True)], "concept string, dimension string, data_type string, active boolean")
    dims = spark.createDataFrame([("℃", "temperature"), ("kg", "mass")], "unit string, dimension string")
    nodes = spark.createDataFrame([("a", "Core Temperature", [], "℃", "numeric"), ("b", "weight", [], "℃", "numeric"), ("c", "zzz", [], None, "text")], "node string, label string, parents array<string>, unit string, data_type string")
    found = matching.retrieve(nodes, aliases, concepts, dims)
    got = {r["node"]: (r["concept"], r["status"]) for r in matching.judge(found, nodes).collect()}
    assert got == {"a": ("temp", "AUTO_APPROVED"), "b": ("mass", "REVIEW_REQUIRED"), "c": (None, "UNMAPPED")}
    score = found.where("node = 'a'").first()["score"]
    assert math.isclose(score, 1.0 + 0.65 + 0.15 + 0.05)
    ratio = spark.createDataFrame([("abcd", "bcde"), ("a", None)], "a string, b string").select(matching.sequence_ratio("a", "b")).collect()
    assert ratio[0][0] == 0.75 and ratio[1][0] is None


def test_nearest_prefers_earlier_on_ties(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 0), (3, "z", 5)], "id long, key string, at long")
    right = spark.createDataFrame([(7, "k", 8), (8, "k", 12), (6, "k", 12)], "rid long, key string, at long")
    got = {r["id"]: (r["rid"], r["distance"]) for r in relational.nearest(left, right, ["key"], "at", "at", "rid").collect()}
    assert got == {1: (7, 2.0), 2: (7, 8.0), 3: (None, None)}


def test_structure_on_a_sheet(spark):
    rows = [("s", 1, 1, "name", None), ("s", 1, 2, "size", None), ("s", 1, 3, "load", None), ("s", 2, 2, "mm", None), ("s", 2, 3, "(kg)", None), ("s", 3, 1, "a", None), ("s", 3, 2, None, 1.0), ("s", 3, 3, None, 2.0), ("s", 6, 1, "lot", None), ("s", 6, 2, None, 9.0)]
    df = spark.createDataFrame(rows, "sheet string, row int, col int, text string, num double")
    banded = structure.bands(df)
    fields = structure.table_fields(banded, Units.parse().spellings()).collect()
    assert {(r["label"], r["unit"], r["row_key"], r["num"]) for r in fields} == {("size", "mm", "a", 1.0), ("load", "kg", "a", 2.0)}
    grid = structure.a1_range(df, 3, 2, 3, 3).first()["values"]
    assert [[c["num"] for c in row] for row in grid] == [[1.0, 2.0]]
    merged = df.limit(1).selectExpr("*", "2 last_row", "2 last_col")
    assert structure.resolve_merges(merged).count() == 4


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,1.5\n,2\n")
    got = {(r["row"], r["col"], r["text"], r["num"]) for r in readers.cells_of_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {(1, 1, "x", None), (1, 2, None, 1.5), (2, 2, None, 2.0)}
    concepts, relations, aliases = readers.domain_graph(spark, "concepts: [{id: t, name: temp, aliases: [T], relations: [{type: IS_A, to: q}]}]")
    assert relations.collect()[0]["parent"] == "q" and writers.concepts_yaml(concepts, aliases).count("temp") == 1
    with pytest.raises(ValueError):
        readers.domain_graph(spark, "concepts: [{id: t, name: temp, relations: [{type: NO, to: q}]}]")
    mixed = spark.sql("select named_struct('num', 180D, 'text', cast(null as string)) v, 1 k")
    writers.write_csv(mixed, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).first()["v"] == "180.0"


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in versioning.upsert(t, c, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in versioning.insert_missing(t, c, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_stable_ids_tell_nulls_and_separators_apart(spark):
    df = spark.createDataFrame([("a", "b|c"), ("a|b", "c"), ("a", None), (None, "a"), ("a", ""), ('a","b', None), ("a", None)], "x string, y string")
    assert df.select(cells.stable_id(F.col("x"), F.col("y")).alias("id")).distinct().count() == 6
