"""Queries of joins, windows, roll-ups, sets, graphs, versions and matching over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from celldag.functions import cells
from celldag.operators import graph, matching, relational, versioning
from celldag.queries.dag import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@register("SELECT r_name, n_name, c_custkey, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey WHERE r_regionkey = 1")
def lookup_reverse(spark, sf_dir):
    """From a concept (region) over its mappings (nations) and nodes (customers) to their payloads, if any."""
    region = read(spark, sf_dir, "region").where("r_regionkey = 1")
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    big = read(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    joined = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).join(customer, F.col("c_nationkey") == F.col("n_nationkey")).join(big, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("r_name", "n_name", "c_custkey", "o_orderkey")


@register("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def unmapped_anti(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return relational.unmatched(read(spark, sf_dir, "part").select("p_partkey", "p_name"), used, ["p_partkey"])


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_members(spark, sf_dir):
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@register("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_done FROM customer")
def correlated_scalars(spark, sf_dir):
    """One value per outer row, null where absent, counts 0: a left join with an aggregate."""
    per = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0, ["n_done"])


@register("SELECT a.n_name AS name_a, b.n_name AS name_b, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey")
def self_join_relations(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    pairs = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    named = pairs.select(F.col("a.n_name").alias("name_a"), F.col("b.n_name").alias("name_b"), F.col("a.n_regionkey").alias("r_regionkey"))
    return named.join(read(spark, sf_dir, "region"), "r_regionkey").select("name_a", "name_b", "r_name")


_RANGES = "SELECT n_nationkey * 2 AS lo, n_nationkey * 2 + 5 AS hi, n_name FROM nation"


@register(f"SELECT p_partkey, p_size, n_name FROM part JOIN ({_RANGES}) ON p_size BETWEEN lo AND hi")
def range_join_bbox(spark, sf_dir):
    ranges = read(spark, sf_dir, "nation").selectExpr("n_nationkey * 2 lo", "n_nationkey * 2 + 5 hi", "n_name")
    return relational.range_join(read(spark, sf_dir, "part").select("p_partkey", "p_size"), ranges, "p_size", "lo", "hi", 8).select("p_partkey", "p_size", "n_name")


@register("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type FROM events),
p AS (SELECT c.event_id, c.user_id, b.event_id AS near_id, abs(b.us - c.us) AS d, b.us, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(b.us - c.us), b.us, b.event_id) AS n
      FROM (SELECT * FROM e WHERE event_type = 'click') c JOIN (SELECT * FROM e WHERE event_type = 'purchase') b ON b.user_id = c.user_id)
SELECT c.event_id, c.user_id, near_id, CAST(d AS DOUBLE) AS distance FROM (SELECT * FROM e WHERE event_type = 'click') c LEFT JOIN (SELECT * FROM p WHERE n = 1) p USING (event_id)
""")
def nearest_block(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "us")
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("near_id"), "user_id", "us")
    return relational.nearest(clicks, bought, ["user_id"], "us", "us", "near_id").drop("us")


@register("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def win_latest_override(spark, sf_dir):
    return relational.latest(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@register("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5")
def win_topk(spark, sf_dir):
    return relational.top_k(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@register("SELECT l_orderkey, CASE WHEN n = 1 THEN CAST(l_linenumber AS VARCHAR) ELSE concat(l_linenumber, '#', n - 1) END AS key, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) AS n FROM lineitem)")
def win_occurrence_keys(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("base"), "l_partkey", "l_extendedprice")
    return relational.occurrence_keys(lines, ["l_orderkey"], "base", [F.col("l_partkey"), F.col("l_extendedprice")]).select("l_orderkey", "key", "l_partkey")


@register("SELECT user_id, event_id AS top, event_id + 1 AS content_top, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 1000000) AS bottom FROM events WHERE event_type = 'signup'")
def win_next_header(spark, sf_dir):
    heads = read(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "event_id")
    return relational.spans(heads, ["user_id"], "event_id", F.lit(1000000).cast("bigint")).select("user_id", "top", "content_top", "bottom")


@register("""
WITH d AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders),
s AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) <= 30 THEN 0 ELSE 1 END AS s FROM d),
i AS (SELECT *, sum(s) OVER (PARTITION BY o_custkey ORDER BY day) AS island FROM s)
SELECT o_custkey, CAST(island AS BIGINT) AS island, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM i GROUP BY ALL
""")
def islands_sections(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select("o_custkey", F.date_diff(F.to_date("o_orderdate"), F.to_date(F.lit("1992-01-01"))).cast("bigint").alias("day")).distinct()
    return relational.islands(d, ["o_custkey"], "day", 30).groupBy("o_custkey", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))


@register("SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def setop_membership(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return relational.membership(read(spark, sf_dir, "customer").where("c_acctbal > 5000"), orders.where("o_totalprice > 400000"), orders.where("o_orderpriority = '5-LOW'"), "c_custkey")


@register("WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), b AS (SELECT p_partkey FROM part WHERE p_size <= 10), c AS (SELECT l_suppkey, count(*) AS keys, CAST(count(p_partkey) AS BIGINT) AS hits FROM a LEFT JOIN b ON p_partkey = l_partkey GROUP BY 1) SELECT l_suppkey, keys, hits, round(hits * 100.0::DOUBLE / keys, 1) AS pct FROM c WHERE hits > 0")
def setop_match_percent(spark, sf_dir):
    return relational.match_percent(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), read(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey")), "l_suppkey", "l_partkey")


_BEFORE = "SELECT o_orderkey AS k, o_orderpriority AS s, CAST(o_totalprice AS VARCHAR) AS c, CASE WHEN o_orderkey % 11 = 0 THEN 'REMOVED' ELSE 'ACTIVE' END AS status FROM orders WHERE o_orderkey % 7 <> 0"
_AFTER = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderpriority END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE CAST(o_totalprice AS VARCHAR) END AS c FROM orders WHERE o_orderkey % 13 <> 0"


@register(f"""
SELECT k, action FROM (SELECT coalesce(b.k, a.k) AS k, CASE WHEN status IS NULL THEN 'added' WHEN a.k IS NULL AND status = 'ACTIVE' THEN 'removed' WHEN a.k IS NULL THEN NULL WHEN status = 'REMOVED' THEN 'revived' WHEN b.s <> a.s THEN 'changed' WHEN b.c <> a.c THEN 'content' ELSE 'unchanged' END AS action
FROM ({_BEFORE}) b FULL JOIN ({_AFTER}) a ON a.k = b.k) WHERE action IS NOT NULL
""")
def tree_diff(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("string")
    before = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("s"), price.alias("c"), F.when(F.col("o_orderkey") % 11 == 0, "REMOVED").otherwise("ACTIVE").alias("status"))
    after = o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("s"), F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise(price).alias("c"))
    return versioning.diff(before, after, "k", "s", "c")


@register("""
WITH c AS (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS st FROM orders WHERE o_orderkey % 10 <> 1)
SELECT c.k, c.st, 1 AS valid_from, CASE WHEN n.st = c.st THEN NULL ELSE 2 END AS valid_to, coalesce(n.st = c.st, false) AS is_current FROM c LEFT JOIN n ON n.k = c.k
UNION ALL SELECT n.k, n.st, 2, NULL, true FROM n LEFT JOIN c ON n.k = c.k WHERE c.k IS NULL OR n.st <> c.st
""")
def scd2_close_insert(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    current = o.where("o_orderkey % 4 <> 0").selectExpr("o_orderkey k", "o_orderstatus st", "1 valid_from", "cast(null as int) valid_to", "true is_current")
    incoming = o.where("o_orderkey % 10 <> 1").selectExpr("o_orderkey k", "if(o_orderkey % 6 = 0, 'X', o_orderstatus) st")
    return versioning.scd2(current, incoming, "k", ["st"], F.lit(2))


@register("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'new', 1.0")
def upsert_last_wins(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(spark.createDataFrame([(-1, "new", 1.0)], c.schema))
    return versioning.upsert(c, changes, ["c_custkey"])


_EDGES = """
SELECT 1000000 + c_custkey AS child, 1000 + c_nationkey AS parent FROM customer UNION ALL SELECT 1000 + n_nationkey, n_regionkey FROM nation
"""


def _edges(spark, sf_dir):
    a = read(spark, sf_dir, "customer").selectExpr("1000000 + c_custkey child", "cast(1000 + c_nationkey as bigint) parent")
    return a.unionByName(read(spark, sf_dir, "nation").selectExpr("cast(1000 + n_nationkey as bigint) child", "cast(n_regionkey as bigint) parent"))


@register("SELECT 1000000 + c_custkey AS node, CAST(n_regionkey AS BIGINT) AS root, 2 AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey")
def graph_roots(spark, sf_dir):
    return graph.roots(_edges(spark, sf_dir), read(spark, sf_dir, "customer").selectExpr("1000000 + c_custkey node"), 6)


@register("SELECT CAST(r_regionkey AS BIGINT) AS start, node, depth FROM (SELECT r_regionkey, CAST(r_regionkey AS BIGINT) AS node, 0 AS depth FROM region UNION ALL SELECT n_regionkey, 1000 + n_nationkey, 1 FROM nation UNION ALL SELECT n_regionkey, 1000000 + c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey)")
def graph_descendants(spark, sf_dir):
    return graph.descendants(_edges(spark, sf_dir), read(spark, sf_dir, "region").selectExpr("cast(r_regionkey as bigint) node"), 3)


@register("""
SELECT CAST(c_custkey % 5 AS BIGINT) AS child, 1000000 + CAST(c_custkey AS BIGINT) AS parent, n_regionkey = c_custkey % 5 AS cycle FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT CAST(n_nationkey % 5 AS BIGINT), 1000 + CAST(n_nationkey AS BIGINT), n_regionkey = n_nationkey % 5 FROM nation
""")
def graph_cycle(spark, sf_dir):
    """Would an edge from a region up to each customer and nation close a cycle?"""
    customers = read(spark, sf_dir, "customer").selectExpr("cast(c_custkey % 5 as bigint) child", "cast(1000000 + c_custkey as bigint) parent")
    nations = read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey % 5 as bigint) child", "cast(1000 + n_nationkey as bigint) parent")
    return graph.would_cycle(_edges(spark, sf_dir), customers.unionByName(nations), 4)


@register(f"SELECT node, direction, count(*) AS n FROM (SELECT child AS node, 'up' AS direction FROM ({_EDGES}) UNION ALL SELECT parent, 'down' FROM ({_EDGES})) GROUP BY ALL")
def graph_neighbours(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir)).groupBy("node", "direction").agg(F.count("*").alias("n"))


@register("""
WITH v AS (SELECT l_partkey, l_returnflag AS c, CASE WHEN l_quantity > 40 THEN 'human' ELSE 'auto' END AS tier FROM lineitem), n AS (SELECT l_partkey, tier, c, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT l_partkey, max(tier) AS tier FROM v GROUP BY 1), k AS (SELECT n.*, max(n) OVER (PARTITION BY l_partkey) AS top FROM n JOIN t USING (l_partkey, tier)),
w AS (SELECT l_partkey, tier, max(top) AS support, CAST(sum(n) AS BIGINT) AS total, CASE WHEN count(*) FILTER (n = top) = 1 THEN max(c) FILTER (n = top) END AS winner FROM k GROUP BY ALL)
SELECT l_partkey, winner, tier, support, total, coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM k WHERE k.l_partkey = w.l_partkey AND k.c IS DISTINCT FROM w.winner), '') AS dissent FROM w
""")
def vote_two_tier(spark, sf_dir):
    return relational.two_tier_vote(read(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity"), ["l_partkey"], "l_returnflag", F.col("l_quantity") > 40)


@register("WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f, l_linenumber) AS r FROM c) WHERE r = 1")
def mode_unit(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey")
    return relational.mode_first(lines, ["l_suppkey"], "l_linenumber", F.col("l_orderkey"))


@register("WITH f AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS pos FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY pos) AS n FROM f) SELECT c_nationkey, string_agg(c_mktsegment, '|' ORDER BY pos) AS \"values\" FROM r WHERE n <= 4 GROUP BY 1")
def representatives(spark, sf_dir):
    return relational.representatives(read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey"], "c_mktsegment", F.col("c_custkey"))


@register("SELECT n_name, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 2) AS coverage FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def status_report(spark, sf_dir):
    named = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return relational.status_counts(named, ["n_name"], "o_orderstatus", ["F", "O", "P"])


@register("SELECT n_regionkey, count(DISTINCT c_custkey) AS documents, count(DISTINCT c_mktsegment) AS concepts, count(o_orderkey) AS sources, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def group_rollup(spark, sf_dir):
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_regionkey").agg(F.count_distinct("c_custkey").alias("documents"), F.count_distinct("c_mktsegment").alias("concepts"), F.count("o_orderkey").alias("sources"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@register("SELECT l_partkey, CASE WHEN n + t = 0 THEN 'empty' WHEN n * 5 >= (n + t) * 4 THEN 'numeric' WHEN t * 5 >= (n + t) * 4 THEN 'text' ELSE 'mixed' END AS dtype FROM (SELECT l_partkey, count(*) FILTER (l_quantity > 20) AS n, count(*) FILTER (l_quantity <= 20) AS t FROM lineitem GROUP BY 1)")
def inferred_types(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(relational.inferred_type(F.expr("if(l_quantity > 20, l_quantity, null)"), F.col("l_returnflag")).alias("dtype"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, m.measure, m.value FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', nullif(l_discount, 0)), ('l_tax', l_tax)) m(measure, value) WHERE m.value IS NOT NULL")
def unpivot_wide_long(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.expr("nullif(l_discount, 0)").alias("l_discount"), "l_tax")
    return relational.unpivot(lines, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@register("SELECT o_custkey, CAST(sum(1) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(sum(1) FILTER (o_orderstatus = 'O') AS BIGINT) AS O FROM orders GROUP BY 1")
def pivot_long_wide(spark, sf_dir):
    return relational.pivot(read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.lit(1).alias("n")), ["o_custkey"], "o_orderstatus", "n", ["F", "O"])


@register("SELECT p_partkey, substr(sha256(CAST(to_json([p_type, p_name, CAST(p_size AS VARCHAR)]) AS VARCHAR)), 1, 16) AS id FROM part")
def build_fingerprints(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", cells.stable_id(F.col("p_type"), F.col("p_name"), F.col("p_size").cast("string")).alias("id"))


@register("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@register("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat(p_name, ' (zorks)') END AS label, CASE WHEN p_size % 2 = 0 THEN 'kg' END AS unit FROM part")
def text_label_unit_split(spark, sf_dir):
    from celldag.functions.units import Units

    label = F.expr("concat(p_name, if(p_size % 2 = 0, ' (kg)', ' (zorks)'))")
    both = cells.split_label_unit(label, Units.parse().spellings())
    return read(spark, sf_dir, "part").select("p_partkey", both["label"].alias("label"), both["unit"].alias("unit"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate::DATE AS VARCHAR) END AS day, date_trunc('second', o_orderdate) AS moment, strftime(o_orderdate, '%H:%M') AS tod FROM orders")
def parse_dates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    text = F.expr("case o_orderkey % 3 when 0 then 'n/a' when 1 then date_format(o_orderdate, 'yyyy.M.d') else date_format(o_orderdate, 'yyyy/MM/dd') end")
    serial = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400.0 + 25569
    return o.select("o_orderkey", cells.parse_date(text).cast("string").alias("day"), cells.serial_datetime(serial).alias("moment"), cells.time_of_day(F.date_format("o_orderdate", "H:mm:ss")).alias("tod"))


@register("""
WITH t AS (SELECT regexp_replace(lower(p_name), '[\\s()\\[\\]{}.\\-_/·:#]+', '', 'g') AS t, p_name FROM (SELECT DISTINCT p_name FROM part)),
a AS (SELECT DISTINCT p_type AS alias, regexp_replace(lower(p_type), '[\\s()\\[\\]{}.\\-_/·:#]+', '', 'g') AS t FROM part),
g AS (SELECT p_name, substr(t, i, 2) AS g, count(*) AS n FROM t, LATERAL (SELECT unnest(range(1, greatest(length(t) - 1, 1) + 1)) AS i) GROUP BY ALL),
h AS (SELECT alias, substr(t, i, 2) AS g, count(*) AS n FROM a, LATERAL (SELECT unnest(range(1, greatest(length(t) - 1, 1) + 1)) AS i) GROUP BY ALL),
d AS (SELECT p_name, alias, sum(g.n * h.n) AS d FROM g JOIN h USING (g) GROUP BY ALL),
l AS (SELECT p_name, sqrt(sum(n * n)) AS l FROM g GROUP BY 1), r AS (SELECT alias, sqrt(sum(n * n)) AS r FROM h GROUP BY 1)
SELECT p_name AS label, alias, round(d / (l * r), 9) AS cos FROM d JOIN l USING (p_name) JOIN r USING (alias) WHERE d / (l * r) >= 0.2
""")
def ngram_cosine(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    found = matching.cosine_pairs(part.select(F.col("p_name").alias("label")), part.select(F.col("p_type").alias("alias"), F.lit("c").alias("concept")).distinct(), 0.2)
    return found.select("label", "alias", F.round("cos", 9).alias("cos"))


@register()
def match_and_judge(spark, sf_dir):
    """Part names as labels, types as concepts: candidates by all signals, then the rule judge (checked in tests)."""
    part = read(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label"), F.array("p_type").alias("parents"), F.lit(None).cast("string").alias("unit"), F.lit("numeric").alias("data_type"))
    aliases = part.select(F.col("p_type").alias("alias"), F.col("p_type").alias("concept")).distinct()
    concepts = aliases.select("concept", F.lit(None).cast("string").alias("dimension"), F.lit("numeric").alias("data_type"), F.lit(True).alias("active"))
    dims = spark.createDataFrame([("kg", "mass")], "unit string, dimension string")
    return matching.judge(matching.retrieve(nodes, aliases, concepts, dims), nodes)


@register()
def difflib_ratio(spark, sf_dir):
    """Sequence similarity of distinct nation and region names (checked in tests)."""
    n, r = read(spark, sf_dir, "nation").select("n_name", "n_regionkey"), read(spark, sf_dir, "region")
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").distinct()
    return pairs.select("n_name", "r_name", matching.sequence_ratio("n_name", "r_name").alias("ratio"))


@register("SELECT concat('Temp', upper(c_mktsegment), ' 1 °C kg 2 fi ', c_name) AS name, concat('temp', lower(replace(c_mktsegment, ' ', '')), '1°ckg2fi', lower(regexp_replace(c_name, '[ #_-]', '', 'g'))) AS label, c_custkey FROM customer")
def nfkc_normalize(spark, sf_dir):
    """Full-width letters, unit signs, a circled digit and a ligature before the names."""
    wide = F.translate(F.upper("c_mktsegment"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    text = F.concat(F.lit("Ｔｅｍｐ"), wide, F.lit("　１ ℃ ㎏ ② ﬁ "), "c_name")
    return read(spark, sf_dir, "customer").select(cells.nfkc(text).alias("name"), cells.normalize_label(text).alias("label"), "c_custkey")


_HUE = """
WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 101) % 256 AS g, (p_size * 5 + p_partkey * 7) % 256 AS b FROM part),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c)
SELECT p_partkey, CASE WHEN hi - lo <= 12 THEN CASE WHEN hi < 245 THEN 'gray' END WHEN r >= g AND g >= b AND r - b > 20 AND r - g < 40 THEN 'yellow' WHEN r > g AND r > b THEN 'red'
  WHEN b > r AND b >= g THEN 'blue' WHEN g > r AND g > b THEN 'green' END AS hue FROM m
"""


@register(_HUE)
def colour_hue(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    two = lambda e: F.lpad(F.hex(F.expr(e)), 2, "0")
    rgb = F.concat(F.lit("FF"), two("p_partkey * 37 % 256"), two("p_partkey * 101 % 256"), two("(p_size * 5 + p_partkey * 7) % 256"))
    return part.select("p_partkey", cells.hue(rgb).alias("hue"))
