"""Records of orders whose lots have more than five digits, of which some differ beyond the fifth only, against the SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as e
from tests.oracle import TABLES, assert_same, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_lots(tmp_path_factory):
    out = tmp_path_factory.mktemp("long")
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{SMALL}/{t}.parquet", out / f"{t}.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (l_partkey + 100000 AS l_partkey) FROM '{SMALL}/lineitem.parquet') TO '{out}/lineitem.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["records_from_cells", "observations_from_cells", "package_of_records"])
def test_lots_of_six_digits(spark, long_lots, name):
    con = connect(long_lots)
    cut = con.sql("SELECT count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey HAVING count(*) > 1 AND count(DISTINCT l_partkey) = count(*) AND count(DISTINCT l_partkey // 10) < count(*))").fetchall()[0][0]
    assert cut > 0
    assert_same(e.queries()[name](spark, long_lots), con, e.oracle_sql()[name])
