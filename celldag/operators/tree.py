"""The tree of a document: document, sheets, tables, sub-headers, headers, under ids that stay when rows and sheets move.

fields: document, sheet, block, title (the block's), region, region_type, pos, row, label, path (header texts, array), row_key, value (struct of num and text), unit.
A node's id is a hash of what it is called from the document down, never of where it stands: blocks go by title, tables by kind and headers, both with the number of those
before that are called alike.  A table's headers are looked at together in one array; values are only ever grouped within their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celldag.functions.cells import fmt_num
from celldag.operators.versioning import semantic_fingerprint

SAMPLES = 4  # values that stand for a header's
MOSTLY = 0.8  # the share of numbers or texts from which on all count as such


def node_id(*parts: Column) -> Column:
    """16 hex digits of the parts' hash as a JSON array, so that no two lists of parts look alike."""
    return F.substring(semantic_fingerprint(*parts), 1, 16)


def parts(fields: DataFrame, also: tuple[str, ...] = (), sampled: bool = True) -> DataFrame:
    """(*also, document, sheet, block, region, t, region_type, path, label, unit, raw, n, nums, texts, given, hashes, pos, firsts): how often each header's values have a unit, with the sum of their rows' hashes, which doesn't depend on the rows' order.

    raw: the path as given, which is empty where the label stands alone.  firsts: the header's first different values that have this unit, with their places; only if sampled, as values must be told apart for it.
    """
    area = [*also, "document", "sheet", "block", "region"]
    header = [*area, "path", "label"]
    given = fields.withColumns({"raw": F.struct("path"), "path": F.when(F.size("path") > 0, F.col("path")).otherwise(F.array("label")), "unit": F.when(F.col("unit") != "", F.col("unit")), "t": F.when(F.col("title") != "", F.col("title"))})
    num, text = F.col("value.num"), F.col("value.text")
    has = num.isNotNull() | text.isNotNull()
    # Nulls leave the hash as it was, so it is told which are.
    row = F.xxhash64("row_key", num, text, F.col("row_key").isNull(), num.isNull(), text.isNull())
    # A block's title and a region's type are one; as keys they need no sort.
    keys = [*area, "t", "region_type", "path", "label", "unit", "raw"]
    # Sums of hashes can be kept per part of a table and added, so that a change needs the changed rows only.
    sums = [F.count("*").alias("n"), F.count(num).alias("nums"), F.count(F.when(num.isNull(), text)).alias("texts"), F.count_if(has).alias("given"), F.sum(F.when(has, row).cast("decimal(38,0)")).alias("hashes"), F.min("pos").alias("pos")]
    if not sampled:
        return given.groupBy(*keys).agg(*sums).withColumn("firsts", F.array().cast("array<struct<at:struct<row:int,pos:int>,shown:string>>"))
    shown = given.withColumn("shown", F.coalesce("value.text", fmt_num(F.col("value.num"))))
    values = shown.groupBy(*keys, "shown").agg(*sums, F.min(F.struct("row", "pos")).alias("at"))
    # A value is a sample at its first place only.
    values = values.withColumn("new", F.col("shown").isNotNull() & (F.row_number().over(Window.partitionBy(*header, "shown").orderBy("at", "unit", "raw")) == 1))
    values = values.withColumn("place", F.row_number().over(Window.partitionBy(*header).orderBy(F.desc("new"), "at", "shown")))
    firsts = F.collect_list(F.when(F.col("new") & (F.col("place") <= SAMPLES), F.struct("at", "shown")))
    return values.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "nums", "texts", "given", "hashes")], F.min("pos").alias("pos"), firsts.alias("firsts"))


def headers(found: Column) -> Column:
    """An array of headers (path, label, raws, data_type, unit, samples, payload) in order from one of parts, in which a header's lie together."""
    total = lambda of, c: F.aggregate(of, F.lit(0).cast("decimal(38,0)" if c == "hashes" else "long"), lambda s, x: (s + F.coalesce(x[c], F.lit(0))).cast("decimal(38,0)" if c == "hashes" else "long"))

    def one(of: Column) -> Column:
        nums, texts = total(of, "nums"), total(of, "texts")
        kind = F.when(nums + texts == 0, "empty").when(nums >= (nums + texts) * MOSTLY, "numeric").when(texts >= (nums + texts) * MOSTLY, "text").otherwise("mixed")
        of_unit = lambda u: F.filter(of, lambda x: x["unit"] == u)
        # The most common unit, of equally common ones the first.
        units = F.array_distinct(F.array_compact(F.transform(of, lambda x: x["unit"])))
        ranked = F.transform(units, lambda u: F.struct((-total(of_unit(u), "n")).alias("n"), F.array_min(F.transform(of_unit(u), lambda x: x["pos"])).alias("pos"), u.alias("unit")))
        firsts = F.array_sort(F.flatten(F.transform(of, lambda x: x["firsts"])))
        samples = F.when(F.size(firsts) > 0, F.array_join(F.transform(firsts, lambda x: x["shown"]), "|"))
        payload = F.concat_ws("|", total(of, "given").cast("string"), total(of, "hashes").cast("string"))
        return F.struct(of[0]["path"].alias("path"), of[0]["label"].alias("label"), F.array_distinct(F.transform(of, lambda x: x["raw"])).alias("raws"), kind.alias("data_type"), F.array_min(ranked)["unit"].alias("unit"), samples.alias("samples"), payload.alias("payload"))

    same = lambda a, b: a["path"].eqNullSafe(b["path"]) & a["label"].eqNullSafe(b["label"])
    begins = F.filter(F.sequence(F.lit(1), F.size(found)), lambda i: (i == 1) | ~same(F.element_at(found, i), F.element_at(found, F.greatest(i - 1, F.lit(1)))))
    each = F.transform(begins, lambda b, i: F.slice(found, b, F.coalesce(F.get(begins, i + 1), F.size(found) + 1) - b))
    return F.transform(each, one)


def tables(fields: DataFrame, also: tuple[str, ...] = (), sampled: bool = True) -> DataFrame:
    """(*also, document, sheet, block, region, title, kind, block_no, table_no, of_document, of_sheet, heads): every table with its headers, the numbers of blocks and tables before it that are called alike, and whether it is its document's and its sheet's first.

    Each step groups or numbers what the one before it did, so rows that lie by document already are never shuffled again.  Windows that need one order follow each other.
    """
    sheet = [*also, "document", "sheet"]
    area = [*sheet, "block"]
    part = F.struct("path", "label", "unit", "raw", "n", "nums", "texts", "given", "hashes", "pos", "firsts")
    regions = parts(fields, also, sampled).groupBy(*area, "region").agg(F.first("t").alias("t"), F.first("region_type").alias("region_type"), F.array_sort(F.collect_list(part)).alias("found"))
    listed = regions.withColumn("heads", headers(F.col("found"))).drop("found")
    # The headers without units and places: a table is the same one when rows are added or a unit is mended.
    called = F.array_sort(F.array_distinct(F.flatten(F.transform("heads", lambda h: F.transform(h["raws"], lambda r: F.struct(r["path"].alias("path"), h["label"].alias("label")))))))
    named = listed.withColumns({"title": F.coalesce("t", "sheet"), "kind": F.concat_ws(":", "region_type", F.substring(F.sha2(F.to_json(called), 256), 1, 10))})
    titled = named.withColumns({
        "of_block": F.first("title").over(Window.partitionBy(*area).orderBy("region")),
        "of_document": F.row_number().over(Window.partitionBy(*also, "document").orderBy("sheet", "block", "region")) == 1, "of_sheet": F.row_number().over(Window.partitionBy(*sheet).orderBy("block", "region")) == 1,
    })
    numbered = titled.withColumn("table_no", F.row_number().over(Window.partitionBy(*area, "kind").orderBy("region")) - 1).withColumn("block_no", F.dense_rank().over(Window.partitionBy(*sheet, "of_block").orderBy("block")) - 1)
    return numbered.select(*area, "region", "title", "kind", "block_no", "table_no", "of_document", "of_sheet", "heads")


def build(fields: DataFrame, also: tuple[str, ...] = (), sampled: bool = True) -> DataFrame:
    """(*also, node, parent, above, document, node_type, name, tree_path, data_type, unit, samples, semantic, content) of all documents.

    above: the ids from the document down to the parent.  semantic: the hash of what the node means (type, path, name, unit); content also covers its
    values, in whatever order their rows are, so the samples, which go by it, have no part in it.  So a changed value calls for no new mapping.  also: further columns of fields, such as a version; each of their values has a tree of its own.
    sampled: whether samples are wanted.
    """
    named = tables(fields, also, sampled).withColumn("t", F.array(F.lit("doc"), F.col("sheet"), F.concat_ws("#", "title", F.col("block_no").cast("string")), F.concat_ws("#", "kind", F.col("table_no").cast("string"))))
    facts = ("data_type", "unit", "samples", "payload")
    node = lambda kind, name, p, of=None: F.struct(F.lit(kind).alias("node_type"), name.alias("name"), p.alias("p"), *[(F.lit(None).cast("string") if of is None else of[c]).alias(c) for c in facts])
    if_first = lambda flag, x: F.when(F.col(flag), F.array(x)).otherwise(F.slice(F.array(x), F.lit(1), F.lit(0)))
    # The sub-headers' ids are hashes of their paths too, the header's own has its label besides.
    upper = F.array_distinct(F.flatten(F.transform(F.filter("heads", lambda h: F.size(h["path"]) > 1), lambda h: F.transform(F.sequence(F.lit(1), F.size(h["path"]) - 1), lambda n: F.slice(h["path"], F.lit(1), n)))))
    found = F.concat(
        if_first("of_document", node("DOCUMENT", F.col("document"), F.array(F.lit("doc")))), if_first("of_sheet", node("SHEET", F.col("sheet"), F.slice("t", F.lit(1), F.lit(2)))), F.array(node("TABLE", F.col("title"), F.col("t"))),
        F.transform(upper, lambda p: node("SUB_HEADER", F.element_at(p, F.lit(-1)), F.concat(F.col("t"), p))),
        F.transform("heads", lambda h: node("HEADER", h["label"], F.concat(F.col("t"), h["path"], F.array(F.concat(F.lit("="), h["label"]))), h)),
    )
    nodes = named.select(*also, "document", F.explode(found).alias("x")).select(*also, "document", "x.*")
    # A table's path is two steps longer than its sheet's, a header's two longer than its sub-header's.
    last = F.size("p") - F.when(F.col("node_type") == "HEADER", 2).otherwise(1)
    lengths = F.filter(F.sequence(F.lit(1), last), lambda n: n != 3)
    above = F.when(F.size("p") > 1, F.transform(lengths, lambda n: node_id(F.col("document"), F.to_json(F.slice("p", F.lit(1), n))))).otherwise(F.array().cast("array<string>"))
    semantic = semantic_fingerprint(F.col("node_type"), F.to_json("p"), F.col("name"), F.col("unit"))
    out = nodes.withColumns({"node": node_id(F.col("document"), F.to_json("p")), "semantic": semantic, "above": above})
    return out.select(
        *also, "node", F.try_element_at("above", F.lit(-1)).alias("parent"), "above", "document", "node_type", "name", F.array_join("p", "/").alias("tree_path"), "data_type", "unit", "samples", "semantic", semantic_fingerprint(F.col("semantic"), F.col("data_type"), F.col("payload")).alias("content")
    )


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, node, depth) of all nodes, themselves included at depth 0: subtrees and ways up by one join each."""
    line = F.concat("above", F.array("node"))
    return nodes.select("node", F.posexplode(line).alias("at", "ancestor"), F.size("above").alias("n")).select("ancestor", "node", (F.col("n") - F.col("at")).alias("depth"))
