"""Builds: a transformed frame to the output table and its lineage edges, and the way back to a source cell."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from celldag.frame import LFrame, ln
from celldag.functions.cells import is_cell, kind_of, text_of
from celldag.plans.project import NAME
from celldag.session import stored

SOURCES = {"_source_document_id": "document_id", "_source_version_id": "version_id", "_source_sheet": "sheet", "_source_locator": "locator"}


def row_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """`_row_id` 1..n in a total order without bringing all rows to one task.

    Rows are range-partitioned and sorted; each partition's count gives the next one's offset.  The
    sorted rows are stored as Parquet, as counting and numbering both read them.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    inside = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    # Under numbers for names, as names may differ by case only; columns of nulls alone have no Parquet type.
    held = [(i, f) for i, f in enumerate(inside.schema) if not isinstance(f.dataType, NullType)]
    kept = stored(inside.toDF(*[f"c{i}" for i in range(len(inside.columns))]).select(*[f"c{i}" for i, _ in held]))
    known = {i for i, _ in held}
    inside = kept.select(*[F.col(f"c{i}").alias(c) if i in known else F.lit(None).alias(c) for i, c in enumerate(inside.columns)])
    counts = inside.groupBy("__part").agg(F.max("__n").alias("__c"))
    offset = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__o"))  # one row per partition
    return inside.join(F.broadcast(offset), "__part").withColumn("_row_id", (F.col("__n") + F.col("__o")).cast("bigint")).drop("__part", "__n", "__o")


def serialise(fr: LFrame, fields: list[str]) -> DataFrame:
    """Output rows with lineage: _row_id, columns (project fields first, further ones after, only identifiers), sources, companions."""
    columns = [c for c in [*[f for f in fields if f in fr.columns], *[c for c in fr.columns if c not in fields]] if NAME.fullmatch(c)]
    numbered = row_ids(fr.df, ["__frame", "__src", "__ord"])
    return numbered.select("_row_id", *[F.col(f"`{c}`") for c in columns], *[F.col(f"__meta.{m}").alias(s) for s, m in SOURCES.items()], *fr.companions(columns))


def output_rows(serialised: DataFrame) -> DataFrame:
    """The output table: without companions."""
    return serialised.drop(*[c for c in serialised.columns if c.startswith("__ln__")])


def lineage_edges(serialised: DataFrame, steps: list[dict]) -> DataFrame:
    """(row_id, field, payload_id, row_idx, node_id, cell, unit, transform): one row per output cell with a source."""
    names = [c[6:] for c in serialised.columns if c.startswith("__ln__")]
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{ln(c)}`").alias("l")) for c in names])
    long = serialised.select(F.col("_row_id").alias("row_id"), F.explode(cells).alias("e")).where("e.l is not null")
    ops = json.dumps([s["op"] for s in steps])
    return long.select("row_id", "e.field", "e.l.payload_id", "e.l.row_idx", "e.l.node_id", "e.l.cell", "e.l.unit", F.lit(ops).alias("transform"))


def trace(edges: DataFrame, values: DataFrame, nodes: DataFrame, documents: DataFrame, row_id: int, field: str) -> DataFrame:
    """From an output cell to the source cell, its header node and its document."""
    edge = edges.where((F.col("row_id") == row_id) & (F.col("field") == field)).drop("cell", "unit")
    cell = edge.join(values.select("payload_id", "row_idx", "row_key", "value_num", "value_text", "cell_address"), ["payload_id", "row_idx"])
    return cell.join(nodes.select("node_id", "node_name", "tree_path", "unit", "document_id"), "node_id").join(documents.select("document_id", "filename"), "document_id")


def text_table(rows: DataFrame) -> DataFrame:
    """Mixed columns as text, for CSV and other sinks that know no structs."""
    return rows.select(*[text_of(F.col(f"`{c}`"), kind_of(rows, c)).alias(c) if is_cell(kind_of(rows, c)) else F.col(f"`{c}`") for c in rows.columns])
