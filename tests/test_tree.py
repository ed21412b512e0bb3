"""Trees of documents: ids that stay, the levels, and the closure."""

from pyspark.sql import functions as F

from celldag.operators import tree, versioning

FIELDS = "document string, sheet string, block int, title string, region int, region_type string, pos int, row int, label string, path array<string>, row_key string, value struct<num:double,text:string>, unit string"


def field(block, region, row, path, num=None, text=None, unit=None, title="T", key=None, doc="d", sheet="S", pos=0):
    return (doc, sheet, block, title, region, "TABLE", pos, row, path[-1], path, key, (num, text), unit)


BASE = [field(0, 0, 1, ["m", "temp"], 1.0, unit="℃", key="a"), field(0, 0, 2, ["m", "temp"], 2.0, unit="℃", key="b"), field(0, 0, 1, ["m", "name"], text="x", key="a"), field(1, 1, 9, ["z"], 5.0, title=None), field(2, 2, 12, ["z"], 6.0, title=None)]


def build(spark, rows):
    return tree.build(spark.createDataFrame(rows, FIELDS))


def test_levels_and_closure(spark):
    nodes = {r["node"]: r for r in build(spark, BASE).collect()}
    kinds = sorted((r["node_type"], r["name"], nodes[r["parent"]]["name"] if r["parent"] else None) for r in nodes.values())
    assert kinds == [
        ("DOCUMENT", "d", None), ("HEADER", "name", "m"), ("HEADER", "temp", "m"), ("HEADER", "z", "S"), ("HEADER", "z", "S"), ("SHEET", "S", "d"), ("SUB_HEADER", "m", "T"), ("TABLE", "S", "S"), ("TABLE", "S", "S"), ("TABLE", "T", "S"),
    ]
    temp = next(r for r in nodes.values() if r["name"] == "temp")
    assert (temp["data_type"], temp["unit"], temp["samples"]) == ("numeric", "℃", "1.0|2.0")
    plain = set()
    for n in nodes:
        up, depth = n, 0
        while up:
            plain.add((up, n, depth))
            up, depth = nodes[up]["parent"], depth + 1
    assert {tuple(r) for r in tree.closure(build(spark, BASE)).collect()} == plain


def actions(spark, rows):
    old, new = build(spark, BASE), build(spark, rows)
    found = versioning.diff(old.withColumn("status", F.lit("ACTIVE")), new, "node", "semantic", "content")
    names = old.unionByName(new).select("node", "name", "node_type").distinct()
    return sorted((r["node_type"], r["name"], r["action"]) for r in found.join(names, "node").where("action <> 'unchanged'").collect())


def test_what_moves_stays_and_what_changes_is_told(spark):
    moved = [(*r[:2], r[2] + 3, *r[3:6], r[6] + 9, r[7] + 40, *r[8:]) for r in BASE]
    assert actions(spark, moved) == []
    assert actions(spark, BASE[1::-1] + BASE[2:]) == []
    assert actions(spark, [field(0, 0, 1, ["m", "temp"], 7.0, unit="℃", key="a"), *BASE[1:]]) == [("HEADER", "temp", "content")]
    assert actions(spark, [r[:-1] + ("K",) if r[8] == "temp" else r for r in BASE]) == [("HEADER", "temp", "changed")]
    # Of two tables called alike the first goes: the second takes its place, with other values.
    assert actions(spark, BASE[:3] + BASE[4:]) == [("HEADER", "z", "content"), ("HEADER", "z", "removed"), ("TABLE", "S", "removed")]
    # Names with separators don't run into each other.
    a, b = build(spark, [field(0, 0, 1, ["a/b", "c"], 1.0)]), build(spark, [field(0, 0, 1, ["a", "b/c"], 1.0)])
    assert not {r["node"] for r in a.where("node_type = 'HEADER'").collect()} & {r["node"] for r in b.where("node_type = 'HEADER'").collect()}


def test_versions_side_by_side_need_no_shuffle_within_documents(spark):
    new = [field(0, 0, 1, ["m", "temp"], 7.0, unit="℃", key="a"), *BASE[1:4]]
    both = spark.createDataFrame([(1, *r) for r in BASE] + [(2, *r) for r in new], "version int, " + FIELDS).repartition(3, "document")
    nodes = tree.build(both, ("version",))
    for version, rows in ((1, BASE), (2, new)):
        assert sorted(map(str, nodes.where(F.col("version") == version).drop("version").collect())) == sorted(map(str, build(spark, rows).collect()))
    found = versioning.diff_together(nodes, ["document", "node"], F.col("version") == 2, "semantic", "content")
    plain = versioning.diff(build(spark, BASE).withColumn("status", F.lit("ACTIVE")), build(spark, new), "node", "semantic", "content")
    assert {(r["node"], r["action"]) for r in found.collect()} == {(r["node"], r["action"]) for r in plain.collect()}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_rows_in_another_order_are_no_change(spark):
    turned = [field(0, 0, 2, ["m", "temp"], 1.0, unit="℃", key="a"), field(0, 0, 1, ["m", "temp"], 2.0, unit="℃", key="b"), *BASE[2:]]
    assert actions(spark, turned) == []
    assert [r["samples"] for r in build(spark, turned).where("name = 'temp'").collect()] == ["2.0|1.0"]


def test_tables_that_hold_equal_lines_in_another_order_match_the_sql(spark, sf_dir, tmp_path):
    """Order 1 goes, so order 2 takes its table's place; two lines have one number and lie by part."""
    import duckdb

    import __spark_entry__ as e
    from tests.oracle import TABLES, assert_same, connect

    for t in TABLES:
        if t not in ("orders", "lineitem"):
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    duckdb.sql(f"COPY (SELECT * EXCLUDE k REPLACE (k::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey) FROM (SELECT * FROM '{sf_dir}/orders.parquet' LIMIT 1), (VALUES (1), (2)) v(k)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    lines = "(VALUES (1, 5, 'A', 3.0), (1, 6, 'N', 4.0), (2, 5, 'N', 4.0), (2, 6, 'A', 3.0)) v(k, part, flag, qty)"
    duckdb.sql(f"COPY (SELECT * EXCLUDE (k, part, flag, qty) REPLACE (k::BIGINT AS l_orderkey, part::BIGINT AS l_partkey, 1::INT AS l_linenumber, flag AS l_returnflag, qty::DOUBLE AS l_quantity) FROM (SELECT * FROM '{sf_dir}/lineitem.parquet' LIMIT 1), {lines}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    found = e.queries()["tree_of_two_versions"](spark, str(tmp_path))
    assert_same(found, connect(str(tmp_path)), e.oracle_sql()["tree_of_two_versions"])
