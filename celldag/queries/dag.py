"""Queries of the transformation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celldag.frame import LFrame
from celldag.functions.cells import fmt_num
from celldag.operators.dag import Env, run_dag

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark, sf_dir, name, order, columns=None) -> LFrame:
    return LFrame.of(read(spark, sf_dir, name), F.expr(order), columns=columns)


@register("SELECT p_partkey AS part, CAST(p_size AS VARCHAR) AS size_text, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS brand_no FROM part")
def op_select_rename_cast(spark, sf_dir):
    fr = LFrame.of(read(spark, sf_dir, "part").withColumn("brand_no", F.expr("substring(p_brand, 7)")), F.col("p_partkey"))
    steps = [{"op": "select", "config": {"columns": ["p_partkey", "p_size", "brand_no", "no_such"]}}, {"op": "rename", "config": {"map": {"p_partkey": "part", "p_size": "size_text"}}}, {"op": "type_cast", "config": {"types": {"size_text": "text", "brand_no": "numeric"}}}]
    return run_dag(fr, steps).rows()


def _statuses(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"), "o_totalprice")
    return LFrame.of(orders, F.col("o_orderkey"))


_STATUS = "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders WHERE "


@register(_STATUS + "nullif(o_orderstatus, 'P') IS NULL")
def op_filter_eq_null(spark, sf_dir):
    return run_dag(_statuses(spark, sf_dir), [{"op": "filter", "config": {"column": "status", "op": "==", "value": None}}]).rows()


@register(_STATUS + "nullif(o_orderstatus, 'P') IS DISTINCT FROM 'O'")
def op_filter_ne_null(spark, sf_dir):
    return run_dag(_statuses(spark, sf_dir), [{"op": "filter", "config": {"column": "status", "op": "!=", "value": "O"}}]).rows()


@register(_STATUS + "o_totalprice >= 200000 AND o_totalprice < 300000")
def op_filter_compare(spark, sf_dir):
    return run_dag(_statuses(spark, sf_dir), [{"op": "filter", "config": {"column": "o_totalprice", "op": op, "value": v}} for op, v in ((">=", 200000), ("<", 300000))]).rows()


@register("SELECT p_partkey, p_name, p_size FROM part WHERE contains(p_name, 'a') AND contains(CAST(p_size AS VARCHAR), '1')")
def op_filter_contains(spark, sf_dir):
    fr = frame(spark, sf_dir, "part", "p_partkey", ["p_partkey", "p_name", "p_size"])
    return run_dag(fr, [{"op": "filter", "config": {"column": c, "op": "contains", "value": v}} for c, v in (("p_name", "a"), ("p_size", 1))]).rows()


_UNITS = "CASE event_type WHEN 'view' THEN '°F' WHEN 'click' THEN '℃' WHEN 'purchase' THEN 'K' WHEN 'error' THEN 'KRW' END"


def _converted(spark, sf_dir, env):
    events = read(spark, sf_dir, "events").select("event_id", "value", F.expr(_UNITS).alias("unit"))
    env.unit_columns["value"] = "unit"
    return run_dag(LFrame.of(events, F.col("event_id")), [{"op": "unit_convert", "config": {"targets": {"value": "℃"}}}], env)


@register(f"SELECT event_id, unit, CASE unit WHEN '°F' THEN round(value * 0.5555555555555556 + -17.77777777777778, 6) WHEN 'K' THEN round(value * 1.0 + -273.15, 6) ELSE value END AS value FROM (SELECT event_id, value, {_UNITS} AS unit FROM events)")
def op_unit_convert(spark, sf_dir):
    return _converted(spark, sf_dir, Env()).rows()


@register(f"SELECT 'value' AS \"column\", 'KRW' AS from_unit, '℃' AS to_unit, count(*) AS cells FROM events WHERE {_UNITS} = 'KRW' AND value IS NOT NULL HAVING count(*) > 0")
def op_unit_convert_warnings(spark, sf_dir):
    env = Env()
    _converted(spark, sf_dir, env)
    return env.warnings[0]


def _normalised(spark, sf_dir, text, steps):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(text).alias("raw"))
    fr = LFrame.of(lines, F.col("l_orderkey"))
    out = run_dag(fr, [{"op": "value_normalize", "config": {"rules": [{"columns": ["raw"], "steps": steps}]}}]).rows()
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("raw.num").alias("num"), F.col("raw.text").alias("text"))


_LINE = "SELECT l_orderkey, l_linenumber, l_partkey, "


@register(_LINE + "CAST(NULL AS DOUBLE) AS num, concat('x', l_shipdate::DATE::VARCHAR, 'y') AS text FROM lineitem")
def op_value_normalize_trim(spark, sf_dir):
    return _normalised(spark, sf_dir, "concat(' \\t\\u00a0x', cast(cast(l_shipdate as date) as string), 'y\\u00a0 ')", [{"op": "trim_text"}])


@register(_LINE + "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS text FROM lineitem")
def op_value_normalize_thousands(spark, sf_dir):
    return _normalised(spark, sf_dir, "format_number(floor(l_extendedprice), 0)", [{"op": "strip_thousands"}])


@register(_LINE + "CAST(round(l_discount * 100) AS BIGINT) / 100.0::DOUBLE AS num, CAST(NULL AS VARCHAR) AS text FROM lineitem")
def op_value_normalize_percent(spark, sf_dir):
    return _normalised(spark, sf_dir, "concat(cast(round(l_discount * 100) as bigint), ' %')", [{"op": "percent_to_ratio"}])


@register(_LINE + "CASE WHEN l_linenumber % 2 = 0 THEN floor(l_quantity) END AS num, CASE WHEN l_linenumber % 2 = 1 THEN concat(CAST(l_quantity AS BIGINT), ' zorks') END AS text FROM lineitem")
def op_value_normalize_unit_suffix(spark, sf_dir):
    return _normalised(spark, sf_dir, "concat(cast(l_quantity as bigint), if(l_linenumber % 2 = 0, ' Kg', ' zorks'))", [{"op": "split_unit_suffix"}])


@register("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS o_orderstatus FROM orders")
def op_value_mapping(spark, sf_dir):
    fr = frame(spark, sf_dir, "orders", "o_orderkey", ["o_orderkey", "o_orderstatus"])
    return run_dag(fr, [{"op": "value_mapping", "config": {"column": "o_orderstatus", "map": {"O": "open", "F": "done"}, "default": "other"}}]).rows()


@register("SELECT p_partkey, CASE p_size WHEN 10 THEN 'ten' WHEN 20 THEN 'twenty' ELSE concat(CAST(p_size AS VARCHAR), '.0') END AS size FROM part")
def op_value_mapping_numeric(spark, sf_dir):
    fr = LFrame.of(read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size")), F.col("p_partkey"))
    out = run_dag(fr, [{"op": "value_mapping", "config": {"column": "size", "map": {"10": "ten", 20: "twenty"}}}]).rows()
    return out.select("p_partkey", F.coalesce(F.col("size.text"), fmt_num(F.col("size.num"))).alias("size"))


@register("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL")
def op_null_drop(spark, sf_dir):
    return run_dag(_statuses(spark, sf_dir), [{"op": "null_handling", "config": {"columns": ["status"]}}]).rows()


@register("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status, o_totalprice FROM orders")
def op_null_fill(spark, sf_dir):
    return run_dag(_statuses(spark, sf_dir), [{"op": "null_handling", "config": {"columns": ["status", "no_such"], "mode": "fill", "fill_value": "none"}}]).rows()


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_tax + 1.0::DOUBLE AS a, l_extendedprice - l_discount AS b, l_extendedprice * l_quantity AS c, l_extendedprice / nullif(l_tax, 0) AS d FROM lineitem")
def op_derived_columns(spark, sf_dir):
    fr = frame(spark, sf_dir, "lineitem", "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount", "l_quantity", "l_extendedprice"])
    made = [("a", "add", "l_tax", 1), ("b", "sub", "l_extendedprice", "l_discount"), ("c", "mul", "l_extendedprice", "l_quantity"), ("d", "div", "l_extendedprice", "l_tax")]
    steps = [{"op": "derived_column", "config": {"name": n, "expr": {"op": o, "left": x, "right": y}}} for n, o, x, y in made]
    return run_dag(fr, [*steps, {"op": "select", "config": {"columns": ["l_orderkey", "l_linenumber", "l_partkey", "a", "b", "c", "d"]}}]).rows()


_RULES = [{"column": "l_quantity", "op": "<=", "value": 45}, {"column": "l_discount", "op": "!=", "value": 0.05}, {"column": "l_returnflag", "op": "!=", "value": "R"}]
_VALID = "l_quantity <= 45 AND l_discount <> 0.05 AND l_returnflag <> 'R'"
_CHECKED = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag"]


@register(f"SELECT {', '.join(_CHECKED)}, CASE WHEN {_VALID} THEN 1 ELSE 0 END AS _valid FROM lineitem")
def op_validation_flag(spark, sf_dir):
    return run_dag(frame(spark, sf_dir, "lineitem", "l_orderkey", _CHECKED), [{"op": "validation", "config": {"rules": _RULES}}]).rows()


@register(f"SELECT {', '.join(_CHECKED)} FROM lineitem WHERE {_VALID}")
def op_validation_drop(spark, sf_dir):
    return run_dag(frame(spark, sf_dir, "lineitem", "l_orderkey", _CHECKED), [{"op": "validation", "config": {"rules": _RULES, "mode": "drop"}}]).rows()


_LINE_ORDER = "l_partkey * 100000000000 + cast(round(l_extendedprice * 100) as bigint)"


@register(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS n FROM lineitem) WHERE n = 1")
def op_dedup_keys_first(spark, sf_dir):
    fr = frame(spark, sf_dir, "lineitem", _LINE_ORDER, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return run_dag(fr, [{"op": "deduplicate", "config": {"keys": ["l_orderkey", "l_linenumber"]}}]).rows()


@register("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def op_union_widen(spark, sf_dir):
    a = LFrame.of(read(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal balance"), F.col("id"))
    b = LFrame.of(read(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_name name", "c_acctbal balance", "c_mktsegment segment"), F.col("id"), frame=1)
    return run_dag(a.together(b), [{"op": "union"}]).rows()


@register("""
SELECT c_custkey AS k, coalesce(last_price, c_acctbal) AS amount, c_mktsegment AS segment, n_orders
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_totalprice > 250000) AS last_price, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def op_join_coalesce(spark, sf_dir):
    a = LFrame.of(read(spark, sf_dir, "customer").selectExpr("c_custkey k", "c_acctbal amount", "c_mktsegment segment"), F.col("k"))
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.expr("if(o_totalprice > 250000, o_totalprice, null)")).alias("amount"), F.count("*").alias("n_orders"))
    return run_dag(a.together(LFrame.of(orders, F.col("k"), frame=1)), [{"op": "join", "config": {"on": ["k"]}}]).rows()


@register("""
SELECT nullif(l_returnflag, 'N') AS flag, l_linestatus AS status, CAST(sum(CAST(q AS DECIMAL(20,2))) AS DOUBLE) AS q, round(avg(l_discount), 6) AS l_discount, min(l_tax) AS l_tax, max(l_extendedprice) AS l_extendedprice, count(*) AS n
FROM (SELECT *, l_quantity AS q FROM lineitem) GROUP BY ALL
""")
def op_aggregate(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").selectExpr("nullif(l_returnflag, 'N') flag", "l_linestatus status", "l_quantity q", "l_discount", "l_tax", "l_extendedprice", "l_orderkey", "nullif(l_returnflag, 'N') n")
    fr = LFrame.of(lines, F.col("l_orderkey"))
    out = run_dag(fr, [{"op": "aggregate", "config": {"group_by": ["flag", "status"], "aggs": {"q": "sum", "l_discount": "avg", "l_tax": "min", "l_extendedprice": "max", "n": "count"}}}]).rows()
    return out.withColumn("l_discount", F.round("l_discount", 6))
