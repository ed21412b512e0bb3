"""Source assembly: long payload rows to one frame per region, columns aligned by row key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celldag.frame import LINEAGE, META, LFrame, ln
from celldag.functions.cells import CELL

ROWS_A_TASK = 250_000


def row_base_key() -> F.Column:
    """The row key, or @r and the digits of the cell's address, or @r and the row's index."""
    digits = F.regexp_replace(F.coalesce("cell_address", F.lit("")), "[^0-9]", "")
    fallback = F.concat(F.lit("@r"), F.when(digits != "", digits).otherwise(F.col("row_idx").cast("string")))
    return F.when(F.coalesce("row_key", F.lit("")) != "", F.col("row_key")).otherwise(fallback)


def keyed_cells(selection: DataFrame, values: DataFrame) -> DataFrame:
    """One row per selected cell: region, field, pos (field, node and row order), key, value and lineage.

    selection: region, field, field_pos, node_id, payload_id, unit, version_id.  values: payload_id,
    row_idx, row_key, value_num, value_text, cell_address.  A key that comes again in a region's
    column gets #1, #2 and so on.
    """
    # All that follows is by region, whose rows are one frame: laid out once, they need no further shuffle.  More rows make more tasks, not larger ones.
    parts = max(1, -(-values.count() // ROWS_A_TASK))
    cells = selection.join(values, "payload_id").repartition(parts, "region").withColumn("base", row_base_key())
    seen = Window.partitionBy("region", "field", "base").orderBy("node_id", "row_idx", "payload_id")
    cells = cells.withColumn("n", F.row_number().over(seen) - 1)
    key = F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("#", "base", F.col("n").cast("string")))
    value = F.struct(F.col("value_num").cast("double").alias("num"), F.when(F.col("value_num").isNull(), F.col("value_text")).alias("text")).cast(CELL)
    none = F.lit(None)
    lineage = F.struct(
        "payload_id", F.col("row_idx").cast("bigint").alias("row_idx"), "node_id", "unit", "version_id", F.col("cell_address").alias("cell"),
        none.cast("string").alias("derived"), none.cast("string").alias("aggregated"), none.cast("array<string>").alias("normalized"),
    ).cast(LINEAGE)
    return cells.select("region", "field", F.struct("field_pos", "node_id", "row_idx").alias("pos"), key.alias("key"), F.struct(value.alias("v"), lineage.alias("l")).alias("cell"))


def aligned(cells: DataFrame, fields: list[str]) -> DataFrame:
    """(region, key, pos, one struct of value and lineage per field): the outer alignment by key."""
    picks = [F.expr(f"min_by(cell, pos) FILTER (WHERE field = '{f}')").alias(f) for f in fields]
    return cells.groupBy("region", "key").agg(F.min("pos").alias("pos"), *picks)


def scope_broadcast(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows whose key is base@x get the columns they lack from the region's rows of key base (or base#n); those rows then go."""
    scope = F.when(F.contains("key", F.lit("@")), F.substring_index("key", "@", 1))
    label = F.when(~F.contains("key", F.lit("@")), F.substring_index("key", "#", 1))
    marked = rows.withColumns({"__scope": scope, "__label": label}).withColumn("__meet", F.coalesce("__scope", "__label"))
    # Both kinds of rows meet in a window, which needs no shuffle where rows lie by region already.
    both = Window.partitionBy("region", "__meet")
    told = {f"__of_{f}": F.min_by(F.col(f"`{f}`"), F.when(F.col("__label").isNotNull() & F.col(f"`{f}`").isNotNull(), F.col("pos"))).over(both) for f in fields}
    met = marked.withColumns({"__scoped": F.max(F.col("__scope").isNotNull()).over(both), **told})
    kept = met.where(F.col("__scope").isNotNull() | ~F.col("__scoped") | F.col("region").isNull())
    of_label = lambda f: F.when(F.col("__scope").isNotNull() & F.col("region").isNotNull(), F.col(f"`__of_{f}`"))
    return kept.select("region", "key", "pos", *[F.coalesce(F.col(f"`{f}`"), of_label(f)).alias(f) for f in fields])


def assemble(selection: DataFrame, values: DataFrame, fields: list[str], regions: DataFrame | None = None) -> LFrame:
    """One frame per region, rows in order of first appearance.  regions: region, document_id, version_id, sheet, locator."""
    rows = scope_broadcast(aligned(keyed_cells(selection, values), fields), fields)
    if regions is not None:
        rows = rows.join(regions.select("region", F.struct("document_id", "version_id", "sheet", "locator").cast(META).alias("__meta")), "region", "left")
    else:
        rows = rows.withColumn("__meta", F.lit(None).cast(META))
    frame = F.xxhash64("region")
    order = F.row_number().over(Window.partitionBy("region").orderBy("pos", "key")).cast("bigint")
    df = rows.select(*[F.col(f"`{f}`.v").alias(f) for f in fields], frame.alias("__frame"), frame.alias("__src"), order.alias("__ord"), "__meta", *[F.col(f"`{f}`.l").alias(ln(f)) for f in fields])
    return LFrame(df, tuple(fields), {}, True)
