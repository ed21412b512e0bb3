"""What plans must not hold, whatever the tables' sizes: seen in the plan alone."""

import pytest

from celldag.catalogue import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("region_")))
def test_cells_are_not_broadcast(name, spark, sf_dir):
    assert "BroadcastExchange" not in plan_of(QUERIES[name](spark, sf_dir))


def test_an_assembly_is_laid_out_once(spark, sf_dir):
    plan = plan_of(QUERIES["build_region_assembly"](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") <= 4  # the selection's distinct rows, the join's two sides, the regions


def test_numbered_rows_are_not_cached(spark, sf_dir):
    assert "InMemoryTableScan" not in plan_of(QUERIES["build_lineage_edges"](spark, sf_dir))


def test_scopes_of_null_regions_do_not_meet(spark):
    from pyspark.sql import functions as F

    from celldag.plans import assemble

    rows = spark.createDataFrame([(None, "a", 1, None, "x"), (None, "a@1", 2, 5.0, None), ("r", "a", 1, None, "y"), ("r", "a@1", 2, 6.0, None), ("r", None, 3, 7.0, None)], "region string, key string, pos int, qty double, label string")
    found = assemble.scope_broadcast(rows.withColumn("pos", F.struct("pos")), ["qty", "label"]).select("region", "key", "qty", "label").collect()
    assert {tuple(r) for r in found} == {(None, "a", None, "x"), (None, "a@1", 5.0, None), ("r", "a@1", 6.0, "y"), ("r", None, 7.0, None)}


def test_old_and_new_records_meet_once(spark, sf_dir):
    plan = plan_of(QUERIES["scd2_close_insert"](spark, sf_dir))
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan and "sha2" not in plan
