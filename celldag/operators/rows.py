"""What the rows of a sheet's block are, and the regions that they form.

cells: sheet, block, row, col, text, num, bold, fill, last_col (of a merge's master, else null), is_formula.  Most of what a row is can be told from its
own cells.  Only whether a row belongs to the table above depends on rows before it: on the columns that headers named since the table began, and on nothing having ended it.  Both
can change at header rows only, so the state is folded over the headers of a block, each with the rows up to the next one, and not over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["sheet", "block"]
# How wide a merged text is a note, and how much of a table's columns a row of it fills.
NOTE_WIDTH, NOTE_LACK, FILLED, FEWEST = 3, 3, 0.6, 2


def row_facts(cells: DataFrame) -> DataFrame:
    """(sheet, block, row, cols, hard, soft): the row's columns; HEADER or NOTE where its own cells decide that (hard); else what it is outside of a table (soft): KV, SUMMARY, NOTE or DATA.

    A single text that is merged over nearly the whole block is a note, two bold texts or more of one fill are a header.  A text with a value one or two columns on is a pair, unless that is a wide text. Two
    pairs make KV; a text with one or two further cells of which some is a number or formula, or alone and not merged, makes SUMMARY; one pair KV; texts alone NOTE.
    """
    is_text = F.col("text").isNotNull() & (F.col("text") != "")
    wide = F.coalesce(F.col("last_col"), F.col("col")) - F.col("col") + 1
    cell = F.struct("col", is_text.alias("t"), wide.alias("w"), F.coalesce("is_formula", F.lit(False)).alias("f"), F.col("last_col").isNotNull().alias("m"), F.when(F.coalesce("bold", F.lit(False)) & is_text, F.col("fill")).alias("head"))
    given = cells.where(is_text | F.col("num").isNotNull())
    # A row has few cells; they are looked at together.
    rows = given.groupBy(*BLOCK, "row").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    width = given.groupBy(*BLOCK).agg((F.max(F.greatest("col", F.coalesce("last_col", "col"))) - F.min("col") + 1).alias("width"))
    heads = F.array_compact(F.transform("c", lambda x: x["head"]))
    at = lambda x, d: F.get(F.filter("c", lambda y: y["col"] == x["col"] + d), F.lit(0))
    following = lambda x: F.coalesce(at(x, 1), at(x, 2))
    pairs = F.size(F.filter("c", lambda x: x["t"] & following(x).isNotNull() & ~F.coalesce(following(x)["t"] & (following(x)["w"] > 2), F.lit(False))))
    n, first, rest = F.size("c"), F.col("c")[0], F.slice("c", F.lit(2), F.size("c"))
    note = (n == 1) & first["t"] & first["m"] & (first["w"] >= F.greatest(F.lit(NOTE_WIDTH), F.col("width") - NOTE_LACK))
    hard = F.when(note, "NOTE").when((F.size(heads) >= 2) & (F.size(F.array_distinct(heads)) == 1), "HEADER")
    summary = (n <= 3) & first["t"] & F.when(n == 1, ~first["m"]).otherwise(F.exists(rest, lambda x: ~x["t"] | x["f"]))
    soft = F.when(F.col("pairs") >= 2, "KV").when(summary, "SUMMARY").when(F.col("pairs") == 1, "KV").when(F.forall("c", lambda x: x["t"]), "NOTE").otherwise("DATA")
    return rows.join(width, BLOCK).withColumn("pairs", pairs).select(*BLOCK, "row", F.transform("c", lambda x: x["col"]).alias("cols"), hard.alias("hard"), soft.alias("soft"))


def _fills(cols: Column, of: Column) -> Column:
    return F.size(F.array_intersect(cols, of)) >= F.greatest(F.lit(FEWEST), F.floor(F.size(of) * FILLED).cast("int"))


def row_kinds(cells: DataFrame, forced: DataFrame | None = None, left_out: DataFrame | None = None) -> DataFrame:
    """(sheet, block, row, kind) of rows with values: HEADER, DATA, KV, SUMMARY or NOTE; rows without values are blank.

    forced: rows (sheet, row) that are headers whatever they hold; left_out: rows that count as blank.  After a header, a row that fills six tenths of the columns named so far (two at least)
    is DATA, until a blank row, or one that is neither, ends the table.  A header within a table adds its columns, a later one begins anew.
    """
    if left_out is not None:
        cells = cells.join(left_out.select("sheet", "row"), ["sheet", "row"], "left_anti")
    facts = row_facts(cells)
    if forced is not None:
        facts = facts.join(forced.select("sheet", "row", F.lit(True).alias("__f")).distinct(), ["sheet", "row"], "left").withColumn("hard", F.when(F.col("__f"), "HEADER").otherwise(F.col("hard"))).drop("__f")
    order = Window.partitionBy(*BLOCK).orderBy("row")
    is_head = F.coalesce(F.col("hard") == "HEADER", F.lit(False))
    placed = facts.withColumns({"gap": F.col("row") - F.lag("row").over(order) > 1, "head": F.max(F.when(is_head, F.col("row"))).over(order)})
    ends = F.coalesce(F.col("gap"), F.lit(False)) | F.col("hard").isNotNull()
    inside = F.struct("row", "cols", ends.alias("ends"), (F.col("soft") != "DATA").alias("other"))
    segments = placed.where("head is not null").groupBy(*BLOCK, "head").agg(
        F.first(F.when(is_head, F.col("cols")), ignorenulls=True).alias("named"), F.max(is_head & F.coalesce(F.col("gap"), F.lit(False))).alias("apart"), F.array_sort(F.collect_list(F.when(~is_head, inside))).alias("rows")
    )
    listed = segments.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct("head", "named", "apart", "rows"))).alias("s"))
    result = "array<struct<head:int,cols:array<int>,until:int>>"

    def step(state: Column, x: Column) -> Column:
        cols = F.when(state["open"] & ~x["apart"], F.array_union(state["cols"], x["named"])).otherwise(x["named"])
        until = F.array_min(F.transform(F.filter(x["rows"], lambda r: r["ends"] | (r["other"] & ~_fills(r["cols"], cols))), lambda r: r["row"]))
        return F.struct(cols.alias("cols"), until.isNull().alias("open"), F.concat(state["out"], F.array(F.struct(x["head"].alias("head"), cols.alias("cols"), until.alias("until")))).alias("out"))

    start = F.struct(F.array().cast("array<int>").alias("cols"), F.lit(False).alias("open"), F.array().cast(result).alias("out"))
    folded = listed.select(*BLOCK, F.explode(F.aggregate("s", start, step, lambda s: s["out"])).alias("o")).select(*BLOCK, "o.*")
    told = placed.join(folded.withColumnRenamed("cols", "table_cols"), [*BLOCK, "head"], "left")
    in_table = F.col("head").isNotNull() & (F.col("until").isNull() | (F.col("row") < F.col("until"))) & _fills(F.col("cols"), F.col("table_cols"))
    return told.select(*BLOCK, "row", F.coalesce("hard", F.when(in_table, "DATA"), "soft").alias("kind"))


def row_regions(kinds: DataFrame) -> DataFrame:
    """(sheet, block, region, region_type, first_row, last_row, header_rows): headers and the data below them are a TABLE; else neighbouring rows of one kind are a KV, SUMMARY or NOTE."""
    order = Window.partitionBy(*BLOCK).orderBy("row")
    before = F.when(F.col("row") - F.lag("row").over(order) == 1, F.lag("kind").over(order))
    begins = before.isNull() | ((F.col("kind") != before) & ~((before == "HEADER") & (F.col("kind") == "DATA")))
    numbered = kinds.withColumn("begins", begins.cast("int")).withColumn("region", F.sum("begins").over(order) - 1)
    kind = F.min_by("kind", "row")
    return numbered.groupBy(*BLOCK, "region").agg(
        F.when(kind == "HEADER", "TABLE").when(kind == "DATA", "NOTE").otherwise(kind).alias("region_type"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count_if(F.col("kind") == "HEADER").alias("header_rows")
    )
