"""Readers of cell tables and of small YAML configuration."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD_VALUE = "payload_id string, row_idx bigint, row_key string, value_num double, value_text string, cell_address string"
RELATIONS = ("IS_A", "PART_OF", "AFFECTS", "MEASURED_BY", "RELATED_TO")


def payload_values(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Long payload rows in any format that Spark reads, under their fixed schema."""
    return spark.read.format(form).schema(PAYLOAD_VALUE).option("header", "true").load(path)


def cells_of_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every field of CSV files as a cell (sheet: the file's path; row and col from 1; num or text).

    A file is one record, so sheets should be of the size that people write; quoted commas and line breaks aren't supported.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("sheet"), F.posexplode(F.split("value", "\r?\n")).alias("r", "line")).where("line <> ''")
    fields = lines.select("sheet", (F.col("r") + 1).alias("row"), F.posexplode(F.split("line", ",")).alias("c", "v")).where("v <> ''")
    number = F.when(F.col("v").rlike(r"^\s*[-+]?\d+(\.\d+)?\s*$"), F.trim("v").try_cast("double"))
    return fields.select("sheet", "row", (F.col("c") + 1).alias("col"), F.when(number.isNull(), F.col("v")).alias("text"), number.alias("num"))


def domain_graph(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts, relations and aliases from YAML `concepts: [{id, name, aliases?, dimension?, data_type?, relations?: [{type, to}]}]`."""
    concepts, relations, aliases = [], [], []
    for c in (yaml.safe_load(text) or {}).get("concepts") or []:
        concepts.append((c["id"], c["name"], c.get("dimension"), c.get("data_type"), True))
        aliases += [(c["id"], a) for a in dict.fromkeys([c["name"], *(c.get("aliases") or [])])]
        for r in c.get("relations") or []:
            if r["type"] not in RELATIONS:
                raise ValueError(f"unknown relation: {r['type']!r}")
            relations.append((c["id"], r["type"], r["to"]))
    return (
        spark.createDataFrame(concepts, "concept string, name string, dimension string, data_type string, active boolean"),
        spark.createDataFrame(relations, "child string, type string, parent string"),
        spark.createDataFrame(aliases, "concept string, alias string"),
    )
