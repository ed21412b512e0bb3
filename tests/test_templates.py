"""Templates and surveys on literal rows."""

from celldag.operators import templates


def test_routing(spark):
    cells = spark.createDataFrame([("a", 1, 1, "Core (Temp)"), ("180도", 1, 1, "x"), ("b", 40, 1, "core temp")], "sheet string, row int, col int, text string")
    rules = spark.createDataFrame([("t1", ["b"], None, ["coretemp"]), ("t2", [], r"^\d+도$", [])], "template string, names array<string>, pattern string, headers array<string>")
    assert {tuple(r) for r in templates.route_sheets(cells, rules).collect()} == {("t1", "b"), ("t1", "a"), ("t2", "180도")}


def test_audit_and_status(spark):
    shape = "template string, sheet string, key string, source string"
    over = spark.createDataFrame([("t", "s", "k1", "A1"), ("t", "s", "k2", "B2"), ("t", "s", "k3", "C3")], shape)
    old = spark.createDataFrame([("t", "s", "k1", "A0"), ("t", "s", "k2", "B0"), ("t", "s", "k3", "C0")], shape)
    new = spark.createDataFrame([("t", "s", "k1", "A1"), ("t", "s", "k2", "B9"), ("t", "s", "k3", "C0")], shape)
    assert {r["key"]: r["status"] for r in templates.version_audit(over, old, new).collect()} == {"k1": "REDUNDANT", "k2": "CONFLICT", "k3": "APPROVED"}
    runs = spark.createDataFrame([(1, True, None), (2, False, "w"), (3, True, "w"), (3, False, None)], "run int, ok boolean, warning string")
    assert {r["run"]: r["status"] for r in templates.run_status(runs).collect()} == {1: "SUCCESS", 2: "FAILED", 3: "REVIEW_REQUIRED"}


def test_survey(spark):
    seen = spark.createDataFrame([("Temp", "℃", "1", "AUTO_APPROVED", "t", 0.9), ("temp.", "K", "2", "AUTO_APPROVED", "t", 0.9), ("x", None, None, "UNMAPPED", None, None), ("y", None, "5", "REVIEW_REQUIRED", "t", 0.4)], "label string, unit string, value string, status string, candidate string, score double")
    got = {r["norm"]: (r["n"], r["kind"], r["units"], r["samples"]) for r in templates.survey_labels(seen).collect()}
    assert got == {"temp": (2, "known", ["K", "℃"], ["1", "2"]), "x": (1, "unknown", [], None), "y": (1, "ambiguous", [], ["5"])}
