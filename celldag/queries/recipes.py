"""Queries of recipe application and of proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from celldag.operators import recipes
from celldag.queries.dag import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


NODES = """nodes AS (SELECT o_custkey AS document, o_orderkey AS node, CAST(o_custkey % 5 AS VARCHAR) AS layout, CAST(o_orderkey % 2 AS VARCHAR) AS occ, o_orderpriority AS place,
  CASE o_orderstatus WHEN 'F' THEN 'HEADER' WHEN 'O' THEN 'SUB_HEADER' ELSE 'CELL' END AS type, CAST(month(o_orderdate) AS VARCHAR) AS name,
  CASE o_orderkey % 4 WHEN 0 THEN 'numeric' WHEN 1 THEN 'text' WHEN 2 THEN 'mixed' END AS data_type, o_orderkey % 9 = 0 AS mapped FROM orders)"""
APPLIED = f"""WITH {NODES},
entry AS (SELECT layout, occ, place, type, name, 'c' || CAST(min(node) % 30 AS VARCHAR) AS concept, CASE WHEN count(*) % 2 = 0 THEN 'APPROVED' ELSE 'AUTO' END AS tier, count(*) - (min(node) % 6 = 0)::INT AS support, count(*) AS total, min(node) % 6 = 0 AS dissent
  FROM nodes WHERE layout = '0' AND occ = '0' OR CAST(name AS INT) > 6 AND layout = '1' GROUP BY ALL),
concept AS (SELECT 'c' || n_nationkey AS concept, n_nationkey % 7 <> 0 AS active, CASE n_nationkey % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'text' ELSE 'category' END AS concept_type FROM nation),
known AS (SELECT * FROM entry LEFT JOIN concept USING (concept)),
alike AS (SELECT place, type, name, count(*) AS n, any_value(concept) AS concept, any_value(tier) AS tier, any_value(support) AS support, any_value(total) AS total, any_value(dissent) AS dissent, any_value(active) AS active, any_value(concept_type) AS concept_type FROM known GROUP BY ALL HAVING count(*) = 1),
hit AS (SELECT n.document, n.node, n.data_type, 'exact' AS match, k.concept, k.tier, k.support, k.total, k.dissent, coalesce(k.active, false) AS active, k.concept_type
    FROM nodes n JOIN known k USING (layout, occ, place, type, name) WHERE n.type <> 'CELL' AND NOT n.mapped
  UNION ALL SELECT n.document, n.node, n.data_type, 'relaxed', a.concept, a.tier, a.support, a.total, a.dissent, coalesce(a.active, false), a.concept_type
    FROM nodes n JOIN alike a USING (place, type, name) WHERE n.type <> 'CELL' AND NOT n.mapped AND NOT EXISTS (SELECT 1 FROM known k WHERE k.layout = n.layout AND k.occ = n.occ AND k.place = n.place AND k.type = n.type AND k.name = n.name)),
judged AS (SELECT *, data_type || '/' || concept_type IN ('numeric/text', 'numeric/category', 'text/numeric', 'text/datetime') AS clash FROM hit),
applied AS (SELECT document, node, concept, match,
    CASE WHEN NOT active THEN 'skipped_stale' WHEN match = 'relaxed' OR dissent OR coalesce(clash, false) THEN 'review' ELSE 'applied' END AS outcome,
    CASE WHEN NOT active THEN NULL WHEN match = 'relaxed' THEN 0.6 WHEN dissent THEN round(support / total, 3) WHEN coalesce(clash, false) THEN 0.6 WHEN tier = 'APPROVED' THEN 1.0 ELSE 0.9 END AS confidence,
    CASE WHEN active THEN 'recipe r: ' || support || ' of ' || total || ' (' || tier || ')' ||
      CASE WHEN match = 'relaxed' THEN ', layout changed' WHEN dissent THEN ', documents disagree' WHEN coalesce(clash, false) THEN ', types ' || data_type || ' and ' || concept_type ELSE '' END END AS reason,
    CASE WHEN active THEN 1 + dissent::INT END AS n_candidates FROM judged
  UNION ALL SELECT document, node, NULL, NULL, 'skipped_mapped', NULL, NULL, NULL FROM nodes WHERE type <> 'CELL' AND mapped)
"""


def _applied(spark, sf_dir):
    """Orders as headers of their customers' sheets; the recipe is what some layouts' orders say, nations are concepts, some of them retired or missing."""
    orders = read(spark, sf_dir, "orders").withColumn("name", F.month("o_orderdate").cast("string")).withColumn("layout", F.col("o_custkey") % 5).withColumn("occ", F.col("o_orderkey") % 2)
    path = F.format_string("TABLE:%d#%d/%s", "layout", "occ", "o_orderpriority")
    nodes = orders.select(
        F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("node"), path.alias("path"), F.expr("case o_orderstatus when 'F' then 'HEADER' when 'O' then 'SUB_HEADER' else 'CELL' end").alias("type"), "name",
        F.expr("case o_orderkey % 4 when 0 then 'numeric' when 1 then 'text' when 2 then 'mixed' end").alias("data_type"), F.expr("o_orderkey % 9 = 0").alias("mapped"), "layout", "occ",
    )
    chosen = nodes.where("layout = 0 and occ = 0 or cast(name as int) > 6 and layout = 1").groupBy("path", "type", "name").agg(F.count("*").alias("total"), F.min("node").alias("first"))
    split = F.col("first") % 6 == 0
    template = chosen.select(
        "path", "type", "name", F.concat(F.lit("c"), F.col("first") % 30).alias("concept"), F.when(F.col("total") % 2 == 0, "APPROVED").otherwise("AUTO").alias("tier"), (F.col("total") - split.cast("int")).alias("support"), "total",
        F.when(split, F.array(F.struct(F.lit("c3").alias("concept"), F.lit(1).cast("long").alias("support")))).alias("dissent"),
    )
    concepts = read(spark, sf_dir, "nation").select(
        F.concat(F.lit("c"), F.col("n_nationkey")).alias("concept"), F.col("n_name").alias("canonical_name"), F.expr("case n_nationkey % 3 when 0 then 'numeric' when 1 then 'text' else 'category' end").alias("data_type"),
        F.expr("if(n_nationkey % 7 <> 0, 'ACTIVE', 'RETIRED')").alias("status"),
    )
    return recipes.apply(nodes, template, concepts, "r")


@register(APPLIED + "SELECT * FROM applied")
def recipe_application(spark, sf_dir):
    return _applied(spark, sf_dir).select("document", "node", "concept", "match", "outcome", "confidence", "reason", F.when(F.col("candidates").isNotNull(), F.size("candidates")).alias("n_candidates"))


@register(APPLIED + """SELECT document, count(*) FILTER (outcome = 'applied') AS applied, count(*) FILTER (outcome = 'review') AS review, count(*) FILTER (outcome = 'review' AND match = 'relaxed') AS relaxed,
  count(*) FILTER (outcome = 'skipped_mapped') AS skipped_mapped, count(*) FILTER (outcome = 'skipped_stale') AS skipped_stale FROM applied GROUP BY document""")  # fmt: skip
def recipe_summary(spark, sf_dir):
    return recipes.summary(_applied(spark, sf_dir))


USABLE = """WITH chosen AS (SELECT DISTINCT l_partkey AS node FROM lineitem),
node AS (SELECT p_partkey AS node, p_brand AS document, CASE p_partkey % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'degC' WHEN 2 THEN '' END AS unit FROM part WHERE p_partkey % 13 <> 0),
mapping AS (SELECT p_partkey AS node, 'c' || (p_size % 30) AS concept, CASE p_partkey % 4 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'APPROVED' ELSE 'AUTO_APPROVED' END AS status FROM part WHERE p_partkey % 11 <> 0),
concept AS (SELECT 'c' || n_nationkey AS concept, n_name AS concept_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Field ' || n_name || '-1' END AS name_en, CASE n_regionkey WHEN 0 THEN 'K' WHEN 1 THEN 'degC' WHEN 2 THEN '' END AS target_unit,
  CASE n_nationkey % 3 WHEN 0 THEN 'numeric' ELSE 'text' END AS data_type FROM nation)
"""


def _selected(spark, sf_dir):
    """Parts that were sold are the chosen nodes; some are gone, unmapped, or mapped to a concept that no nation stands for."""
    chosen = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"))
    part = read(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("document"), F.expr("if(p_partkey % 13 <> 0, 'ACTIVE', 'REMOVED')").alias("status"), F.expr("case p_partkey % 5 when 0 then 'K' when 1 then 'degC' when 2 then '' end").alias("unit"))
    mappings = part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("node"), F.expr("concat('c', p_size % 30)").alias("concept"), F.expr("case p_partkey % 4 when 0 then 'REVIEW_REQUIRED' when 1 then 'APPROVED' else 'AUTO_APPROVED' end").alias("status"))
    concepts = read(spark, sf_dir, "nation").selectExpr(
        "concat('c', n_nationkey) concept", "n_name canonical_name", "if(n_nationkey % 2 = 0, concat('Field ', n_name, '-1'), null) name_en", "case n_regionkey when 0 then 'K' when 1 then 'degC' when 2 then '' end unit",
        "if(n_nationkey % 3 = 0, 'numeric', 'text') data_type",
    )
    return chosen, nodes, mappings, concepts


@register(USABLE + """, used AS (SELECT * FROM chosen JOIN node USING (node) JOIN mapping USING (node) JOIN concept USING (concept)),
g AS (SELECT concept, any_value(concept_name) AS concept_name, any_value(name_en) AS name_en, any_value(target_unit) AS target_unit, any_value(data_type) AS data_type, list_sort(list(DISTINCT unit) FILTER (unit <> '')) AS us,
  count(*) FILTER (status <> 'REVIEW_REQUIRED') AS sources, count(*) FILTER (status = 'REVIEW_REQUIRED') AS review, count(DISTINCT document) AS documents FROM used GROUP BY concept),
h AS (SELECT *, coalesce(len(us), 0) AS n, coalesce(target_unit <> '', false) AS has FROM g),
t AS (SELECT *, CASE WHEN has AND (n > 1 OR n = 1 AND us[1] <> target_unit) THEN array_to_string(us, '/') || ' to ' || target_unit WHEN has THEN 'all in ' || target_unit ELSE 'types made equal' END AS plain FROM h)
SELECT concept, concept_name, regexp_replace(lower(trim(coalesce(name_en, concept))), '[^A-Za-z0-9_]', '_', 'g') AS field_name, target_unit, data_type, coalesce(array_to_string(us, '/'), '') AS units, sources, review, documents,
  CASE WHEN review > 0 OR n > 1 AND NOT has THEN 'REVIEW' ELSE 'OK' END AS status,
  CASE WHEN review > 0 AND sources = 0 THEN review || ' to review before they take part' WHEN review > 0 THEN plain || '; ' || review || ' to review left out' ELSE plain END AS note FROM t""")  # fmt: skip
def proposal_fields(spark, sf_dir):
    return recipes.proposal(*_selected(spark, sf_dir)).withColumn("units", F.array_join("units", "/"))


@register(USABLE + """SELECT node, CASE WHEN node NOT IN (SELECT node FROM node) THEN 'gone' WHEN node NOT IN (SELECT node FROM mapping) THEN 'unmapped' ELSE 'unknown concept' END AS reason
FROM chosen WHERE node NOT IN (SELECT node FROM node JOIN mapping USING (node) JOIN concept USING (concept))""")  # fmt: skip
def proposal_stale(spark, sf_dir):
    return recipes.stale(*_selected(spark, sf_dir))
