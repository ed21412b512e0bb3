"""Nulls, ties, repeats and empty tables in recipes, reviews, recrawls, releases and groups."""

import pytest
from pyspark.sql import functions as F

from celldag.operators import curation, graph


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_version_of_a_recipe_is_active(spark):
    history = spark.createDataFrame([("a", 1, "x", "ARCHIVED"), ("a", 2, "y", "ACTIVE"), ("b", 1, "z", "ACTIVE")], "recipe string, version int, spec string, status string")
    back = curation.rollback(history, spark.createDataFrame([("a", 1), ("a", 1), ("b", 9)], "recipe string, version int"))
    assert rows(back) == [("a", 1, "x", "ARCHIVED"), ("a", 2, "y", "ARCHIVED"), ("a", 3, "x", "ACTIVE"), ("b", 1, "z", "ACTIVE")]
    first = curation.publish(history.limit(0), spark.createDataFrame([("c", "s")], "recipe string, spec string"))
    assert rows(first) == [("c", 1, "s", "ACTIVE")]
    assert curation.publish(history, spark.createDataFrame([], "recipe string, spec string")).count() == 3


def test_snapshot_prefers_people_and_drops_ties(spark):
    votes = spark.createDataFrame([("r", "p", "a", True), ("r", "p", "b", False), ("r", "p", "b", False), ("r", "q", "a", False), ("r", "q", "b", False), ("r", "s", None, True)], "recipe string, path string, concept string, human boolean")
    assert rows(curation.snapshot(votes, F.col("human")).select("path", "winner", "tier", "state")) == [("p", "a", "human", "template"), ("q", None, "auto", "dropped")]


def test_review_touches_active_mappings_only(spark):
    mappings = spark.createDataFrame([("n", "a", "REVIEW", 0.4, True), ("m", "a", "REVIEW", 0.4, False)], "node string, concept string, status string, confidence double, active boolean")
    decisions = spark.createDataFrame([("n", "a", "APPROVE", None, 1), ("n", "a", "REMAP", "b", 2), ("m", "a", "APPROVE", None, 1), ("gone", "a", "REMAP", "b", 1)], "node string, concept string, action string, new_concept string, at int")
    assert rows(curation.review(mappings, decisions)) == [("m", "a", "REVIEW", 0.4, False), ("n", "a", "REVIEW", 0.4, False), ("n", "b", "APPROVED", 1.0, True)]
    assert rows(curation.review(mappings, decisions.limit(0))) == rows(mappings)


def test_recrawl_never_touches_what_people_decided(spark):
    kind = "node string, concept string, status string"
    mappings = spark.createDataFrame([("a", "x", "APPROVED"), ("b", "x", "REJECTED"), ("c", "x", "REVIEW")], kind)
    new = spark.createDataFrame([(n, "y", "AUTO_APPROVED") for n in "abcd"], kind)
    assert rows(curation.recrawl(mappings, new)) == [("a", "x", "APPROVED"), ("b", "x", "REJECTED"), ("c", "x", "REVIEW"), ("d", "y", "AUTO_APPROVED")]
    assert rows(curation.recrawl(mappings, new, "reset_auto")) == [("a", "x", "APPROVED"), ("b", "x", "REJECTED"), ("c", "y", "AUTO_APPROVED"), ("d", "y", "AUTO_APPROVED")]
    with pytest.raises(ValueError):
        curation.recrawl(mappings, new, "all")


def test_rollup_lists_pinned_and_empty_groups(spark):
    sources = spark.createDataFrame([("g", "d1", "c", 5), ("g", "d1", "c", None), ("g", "d2", "k", 7), (None, "d3", "c", 1)], "root string, document string, concept string, n long")
    overrides = spark.createDataFrame([("g", "d2", "EXCLUDED"), ("g", "d1", "INCLUDED"), ("h", "d9", "INCLUDED"), ("h", "d9", "INCLUDED")], "root string, document string, state string")
    recipes = spark.createDataFrame([("e",), ("g",)], "root string")
    assert rows(curation.group_rollup(sources, overrides, recipes)) == [("e", 0, 0, 0, 0), ("g", 1, 1, 2, 5), ("h", 1, 0, 0, 0)]
    assert curation.group_rollup(sources.limit(0), overrides.limit(0), recipes.limit(0)).count() == 0


def test_sources_are_found_by_range_sheet_and_concept(spark):
    nodes = spark.createDataFrame([("n1", "A1:B2", "s", None), ("n2", "A1:B2", "t", "c"), ("n3", None, "s", "c")], "node string, range string, sheet string, concept string")
    sources = spark.createDataFrame([("x", 2, "A1:B2", None, "c"), ("y", 1, "A1:B2", "s", "d"), ("z", 1, None, None, "c")], "source string, place int, range string, sheet string, concept string")
    assert rows(curation.locate(nodes, sources)) == [("n1", "y"), ("n2", "x"), ("n3", None)]


def test_the_nearest_ancestor_of_a_type_within_reach(spark):
    edges = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(14)], "child string, parent string")
    nodes = spark.createDataFrame([(f"k{i}", "TABLE" if i in (3, 14) else "X") for i in range(15)], "node string, type string")
    found = dict(rows(graph.ancestor_of_type(edges, nodes, "TABLE")))
    assert found["k0"] == "k3" and found["k3"] == "k3" and found["k4"] == "k14" and found["k13"] == "k14"
    assert dict(rows(graph.ancestor_of_type(edges, nodes.where("node != 'k3'"), "TABLE")))["k2"] is None


def test_failed_documents_keep_their_mappings_and_stop_no_other(spark):
    kind = "document string, node string, concept string, status string"
    before = spark.createDataFrame([(d, f"{d}{i}", "x", s) for d in "abcdz" for i, s in enumerate(["APPROVED", "REVIEW"])], kind)
    new = spark.createDataFrame([(d, f"{d}{i}", "y", "AUTO_APPROVED") for d in "abcdz" for i in range(3)], kind)
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, None), (3, "d")], "run int, document string")
    files = spark.createDataFrame([("a", "a", None), ("b", "b", "not a workbook"), ("c", "q", None), ("d", "d", None), ("z", "z", None)], "document string, found string, error string")
    judged = curation.judged_documents(asked, files)
    assert rows(judged) == [(1, "a", None), (1, "b", "not a workbook"), (2, "c", "another document"), (2, None, "no file"), (3, "d", None)]
    after = curation.recrawl_documents(before, new, judged, "reset_auto")
    by = lambda d: rows(after.where(F.col("document") == d).drop("document"))
    for d in "bcz":
        assert by(d) == [(f"{d}0", "x", "APPROVED"), (f"{d}1", "x", "REVIEW")]
    for d in "ad":
        assert by(d) == [(f"{d}0", "x", "APPROVED"), (f"{d}1", "y", "AUTO_APPROVED"), (f"{d}2", "y", "AUTO_APPROVED")]
    assert rows(curation.recrawl_summary(before, after, judged)) == [(1, "PARTIAL", 2, 1, 1, 2), (2, "FAILED", 2, 2, 0, 0), (3, "SUCCESS", 1, 0, 1, 2)]
    assert curation.recrawl_documents(before.limit(0), new.limit(0), judged.limit(0)).count() == 0


def test_rollup_meets_each_document_once(spark):
    sources = spark.createDataFrame([("g", 1, "a", 2), ("g", 1, "b", 3), ("g", 1, None, 1), ("g", 2, "a", 4), ("g", None, "c", 5), (None, 3, "a", 6)], "root string, document int, concept string, n int")
    overrides = spark.createDataFrame([("g", 1, "INCLUDED"), ("g", 2, "EXCLUDED"), ("g", 2, "EXCLUDED"), ("g", 4, "INCLUDED"), ("g", 4, "INCLUDED"), ("g", None, "EXCLUDED"), ("p", 7, "EXCLUDED")], "root string, document int, state string")
    found = curation.group_rollup(sources, overrides, spark.createDataFrame([("e",)], "root string"), 3)
    assert sorted(map(tuple, found.collect())) == [("e", 0, 0, 0, 0), ("g", 2, 3, 4, 11)]
    # Rows aren't multiplied for each count, and documents lie in as many tasks as asked for.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "RepartitionByExpression [root" in plan
