"""Queries of recipes, reviews, recrawls, releases and groups of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from celldag.operators import curation, graph
from celldag.queries.dag import read
from celldag.session import stored

ROWS_A_TASK = 250_000

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

HISTORY = "history AS (SELECT o_custkey AS recipe, o_orderkey AS version, o_orderpriority AS spec, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status FROM orders)"


def register(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _history(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recipe"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("spec"))
    last = orders.groupBy("recipe").agg(F.max("version").alias("last"))
    return orders.join(last, "recipe").select("recipe", "version", "spec", F.when(F.col("version") == F.col("last"), "ACTIVE").otherwise("ARCHIVED").alias("status"))


@register("SELECT o_custkey, max(o_orderkey) + 1 AS next FROM orders GROUP BY o_custkey")
def next_version(spark, sf_dir):
    return curation.next_versions(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@register("""
WITH c AS (SELECT l_suppkey AS recipe, l_linenumber AS path, CASE WHEN l_linestatus = 'F' THEN 'human' ELSE 'auto' END AS tier, l_returnflag AS concept, count(*) AS n FROM lineitem GROUP BY ALL),
d AS (SELECT * FROM c QUALIFY tier = max(tier) OVER (PARTITION BY recipe, path)),
a AS (SELECT recipe, path, tier, max(n) AS support, sum(n)::BIGINT AS total FROM d GROUP BY ALL)
SELECT recipe, path, CASE WHEN count(*) = 1 THEN min(concept) END AS winner, tier, support, total, CASE WHEN count(*) > 1 THEN 'dropped' WHEN support < total THEN 'conflict' ELSE 'template' END AS state
FROM a JOIN d USING (recipe, path, tier) WHERE n = support GROUP BY recipe, path, tier, support, total
""")
def recipe_snapshot(spark, sf_dir):
    """Lines vote for a flag per supplier and line number; lines of status F count as decided by people."""
    votes = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("recipe"), F.col("l_linenumber").alias("path"), F.col("l_returnflag").alias("concept"), "l_linestatus")
    return curation.snapshot(votes, F.col("l_linestatus") == "F")


@register(f"""
WITH {HISTORY}, new AS (SELECT c_custkey AS recipe, c_mktsegment AS spec FROM customer WHERE c_acctbal > 0)
SELECT recipe, version, spec, CASE WHEN status = 'ACTIVE' AND recipe IN (SELECT recipe FROM new) THEN 'ARCHIVED' ELSE status END AS status FROM history
UNION ALL SELECT recipe, coalesce((SELECT max(version) FROM history h WHERE h.recipe = new.recipe), 0) + 1, spec, 'ACTIVE' FROM new
""")
def recipe_publish(spark, sf_dir):
    """Orders as versions of a customer's recipe; customers that owe nothing publish another."""
    new = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("recipe"), F.col("c_mktsegment").alias("spec"))
    return curation.publish(_history(spark, sf_dir), new)


@register(f"""
WITH {HISTORY}, back AS (SELECT o_custkey AS recipe, min(o_orderkey) AS version FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT recipe, version, spec, CASE WHEN recipe IN (SELECT recipe FROM back) THEN 'ARCHIVED' ELSE status END AS status FROM history
UNION ALL SELECT recipe, (SELECT max(version) FROM history h WHERE h.recipe = b.recipe) + 1, spec, 'ACTIVE' FROM back b JOIN history USING (recipe, version)
""")
def recipe_rollback(spark, sf_dir):
    """Each customer with finished orders goes back to the first of them; an unknown version changes nothing."""
    back = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("recipe")).agg(F.min("o_orderkey").alias("version"))
    unknown = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recipe"), F.lit(-1).cast("long").alias("version"))
    return curation.rollback(_history(spark, sf_dir), back.unionByName(unknown))


@register("""
SELECT o_orderkey AS node, o_orderpriority AS concept, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'REJECTED' ELSE 'REVIEW' END AS status, 0.5::DOUBLE AS confidence, o_orderstatus <> 'P' AS active FROM orders
UNION ALL SELECT o_orderkey, 'other', 'APPROVED', 1.0::DOUBLE, true FROM orders WHERE o_orderstatus = 'P'
""")
def review_decisions(spark, sf_dir):
    """Finished orders are approved, open ones rejected, pending ones remapped; an earlier decision of another kind doesn't count."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("concept"), "o_orderstatus")
    action = F.when(F.col("o_orderstatus") == "F", "APPROVE").when(F.col("o_orderstatus") == "O", "REJECT").otherwise("REMAP")
    last = orders.select("node", "concept", action.alias("action"), F.lit("other").alias("new_concept"), F.lit(2).alias("at"))
    first = orders.select("node", "concept", F.lit("REJECT").alias("action"), F.lit(None).cast("string").alias("new_concept"), F.lit(1).alias("at"))
    mappings = orders.select("node", "concept", F.lit("REVIEW").alias("status"), F.lit(0.5).alias("confidence"), F.lit(True).alias("active"))
    return curation.review(mappings, first.unionByName(last))


_RECRAWL = """
WITH m AS (SELECT o_orderkey AS node, o_orderpriority AS concept, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'AUTO_APPROVED' ELSE 'REVIEW' END AS status FROM orders WHERE o_totalprice > 100000),
held AS (SELECT * FROM m WHERE {held}), p AS (SELECT l_orderkey AS node, min(l_returnflag) AS concept, 'AUTO_APPROVED' AS status FROM lineitem GROUP BY 1)
SELECT * FROM held UNION ALL SELECT * FROM p WHERE node NOT IN (SELECT node FROM held)
"""


def _recrawl(spark, sf_dir, mode):
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "AUTO_APPROVED").otherwise("REVIEW")
    mappings = read(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("concept"), status.alias("status"))
    proposals = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.min("l_returnflag").alias("concept")).withColumn("status", F.lit("AUTO_APPROVED"))
    return curation.recrawl(mappings, proposals, mode)


@register(_RECRAWL.format(held="true"))
def recrawl_fill(spark, sf_dir):
    return _recrawl(spark, sf_dir, "fill")


@register(_RECRAWL.format(held="status = 'APPROVED'"))
def recrawl_reset_auto(spark, sf_dir):
    return _recrawl(spark, sf_dir, "reset_auto")


@register("""
WITH r AS (SELECT c_custkey AS name, CASE WHEN c_acctbal < 2000 THEN 'REQUESTED' WHEN c_acctbal < 5000 THEN 'RELEASED' ELSE 'DENIED' END AS status FROM customer)
SELECT name, CASE WHEN status IN ('REQUESTED', 'RELEASED') AND name IN (SELECT user_id FROM events) THEN 'INGESTED' WHEN status = 'REQUESTED' AND name IN (SELECT o_custkey FROM orders) THEN 'RELEASED' ELSE status END AS status FROM r
""")
def release_states(spark, sf_dir):
    status = F.when(F.col("c_acctbal") < 2000, "REQUESTED").when(F.col("c_acctbal") < 5000, "RELEASED").otherwise("DENIED")
    requests = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), status.alias("status"))
    return curation.release_states(requests, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name")), read(spark, sf_dir, "events").select(F.col("user_id").alias("name")))


@register("""
WITH s AS (SELECT p_type AS root, l_orderkey AS document, p_brand AS concept, l_quantity AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT 'ECONOMY' AS root, o_orderkey AS document, o_orderstatus FROM orders),
a AS (SELECT root, document, concept, n, 1 AS s FROM s WHERE root <> 'ECONOMY' OR document NOT IN (SELECT document FROM o WHERE o_orderstatus = 'F')
UNION ALL SELECT root, document, NULL, NULL, 0 FROM o WHERE o_orderstatus = 'O' UNION ALL SELECT r_name, NULL, NULL, NULL, 0 FROM region)
SELECT root, count(DISTINCT document) AS documents, count(DISTINCT concept) AS concepts, sum(s)::BIGINT AS sources, coalesce(sum(n), 0) AS n_values FROM a GROUP BY root
""")
def group_rollup_overrides(spark, sf_dir):
    """Orders as documents of a part type: finished ones excluded from and open ones pinned to one type; regions have only a recipe."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("root"), F.col("p_brand").alias("concept"))
    sources = read(spark, sf_dir, "lineitem").join(parts, "l_partkey").select("root", F.col("l_orderkey").alias("document"), "concept", F.col("l_quantity").alias("n"))
    state = F.when(F.col("o_orderstatus") == "F", "EXCLUDED").when(F.col("o_orderstatus") == "O", "INCLUDED")
    overrides = read(spark, sf_dir, "orders").select(F.lit("ECONOMY").alias("root"), F.col("o_orderkey").alias("document"), state.alias("state"))
    tasks = max(spark.sparkContext.defaultParallelism, (read(spark, sf_dir, "lineitem").count() + read(spark, sf_dir, "orders").count()) // ROWS_A_TASK)
    return curation.group_rollup(sources, overrides, read(spark, sf_dir, "region").select(F.col("r_name").alias("root")), tasks)


@register("""
SELECT n_nationkey AS template, n_name AS name, o_orderpriority AS version, count(*) AS documents, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R'))) AS override_documents,
count(*) FILTER (WHERE o_orderstatus = 'P') AS review_required, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
""")
def template_groups(spark, sf_dir):
    """Nations as templates, order priorities as their versions, lines sent back as changes to a document."""
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "REVIEW_REQUIRED").otherwise("APPLIED")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("template"))
    assignments = read(spark, sf_dir, "orders").join(customers, "o_custkey").select("template", F.col("o_orderpriority").alias("version"), F.col("o_orderkey").alias("document"), status.alias("status"))
    changes = F.when(F.col("l_returnflag") == "A", "APPROVED").when(F.col("l_returnflag") == "R", "CONFLICT").otherwise("OPEN")
    overrides = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), changes.alias("status"))
    return curation.template_groups(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("template"), F.col("n_name").alias("name")), assignments, overrides)


@register("""
SELECT n.o_orderkey AS node, min(s.o_orderkey) AS source FROM orders n LEFT JOIN orders s ON s.o_totalprice > 100000 AND s.o_custkey = n.o_custkey
AND (s.o_orderstatus = 'P' OR s.o_orderstatus = n.o_orderstatus) AND (n.o_totalprice < 50000 OR s.o_orderpriority = n.o_orderpriority) GROUP BY 1
""")
def locate_sources(spark, sf_dir):
    """Orders as nodes, large orders as sources; the customer is the range, the status the sheet (none if pending), the priority the concept (none if small)."""
    orders = read(spark, sf_dir, "orders")
    nodes = orders.select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("range"), F.col("o_orderstatus").alias("sheet"), F.when(F.col("o_totalprice") >= 50000, F.col("o_orderpriority")).alias("concept"))
    sources = orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("source"), F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("range"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("sheet"), F.col("o_orderpriority").alias("concept"))
    return curation.locate(nodes, sources)


@register("SELECT p_partkey, sha256(p_name || '|' || p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR)) AS cache_key FROM part")
def cache_keys(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", curation.cache_key(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("cache_key"))


@register("""
SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS ancestor FROM customer UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region
""")
def ancestor_of_type(spark, sf_dir):
    """The nation above each customer; a nation is its own, a region has none."""
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    edges = customer.select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent")).unionByName(nation.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent")))
    kinds = [(customer, "c", "c_custkey", "CUSTOMER"), (nation, "n", "n_nationkey", "TABLE"), (region, "r", "r_regionkey", "REGION")]
    nodes = [df.select(key(letter, column).alias("node"), F.lit(kind).alias("type")) for df, letter, column, kind in kinds]
    return graph.ancestor_of_type(edges, nodes[0].unionByName(nodes[1]).unionByName(nodes[2]), "TABLE")


@register("""
WITH d AS (SELECT o_custkey AS run, o_orderkey AS document, o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 13 = 0 AS bad FROM orders),
n AS (SELECT l_orderkey AS document, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n, l_returnflag FROM lineitem),
c AS (SELECT document, count(*) FILTER (n % 2 = 0 AND l_returnflag <> 'A') AS reset, count(*) FILTER (n % 2 = 1 OR l_returnflag <> 'A') AS mapped FROM n GROUP BY document)
SELECT run, CASE count(*) FILTER (bad) WHEN 0 THEN 'SUCCESS' WHEN count(*) THEN 'FAILED' ELSE 'PARTIAL' END AS status, count(*) AS documents, count(*) FILTER (bad) AS errors,
  CAST(coalesce(sum(reset) FILTER (NOT bad), 0) AS BIGINT) AS reset, CAST(coalesce(sum(mapped) FILTER (NOT bad), 0) AS BIGINT) AS mapped FROM d LEFT JOIN c USING (document) GROUP BY run
""")
def recrawl_runs(spark, sf_dir):
    """A run per customer over its orders, of which some have no file, some can't be read and some have moved; half of the lines were mapped before."""
    orders = read(spark, sf_dir, "orders")
    files = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("document"), F.expr("if(o_orderkey % 13 = 0, -o_orderkey, o_orderkey)").alias("found"), F.expr("if(o_orderkey % 5 = 0, 'not a workbook', null)").alias("error"))
    judged = stored(curation.judged_documents(orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("document")), files))
    lines = read(spark, sf_dir, "lineitem").withColumn("n", F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"))
    nodes = lines.select(F.col("l_orderkey").alias("document"), F.concat_ws("/", "l_orderkey", "n").alias("node"), "n", F.expr("case l_returnflag when 'A' then 'APPROVED' when 'N' then 'AUTO_APPROVED' else 'REVIEW' end").alias("status"))
    before = stored(nodes.where("n % 2 = 0").select("document", "node", F.lit("old").alias("concept"), "status"))
    proposals = nodes.select("document", "node", F.lit("new").alias("concept"), F.lit("AUTO_APPROVED").alias("status"))
    after = stored(curation.recrawl_documents(before, proposals, judged, "reset_auto"))
    return curation.recrawl_summary(before, after, judged)
