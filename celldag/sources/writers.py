"""Sinks: output tables, record packages, exports."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame

from celldag.plans.build import text_table


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; mixed columns as text."""
    text_table(rows).write.mode("overwrite").option("header", "true").csv(path)


def write_records(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a total order: equal input gives equal files."""
    rows.orderBy(*order).write.mode("overwrite").json(path)


def concepts_yaml(concepts: DataFrame, aliases: DataFrame) -> str:
    """The concept list as YAML, empty entries left out.  For curated vocabularies, which are small by nature."""
    names = {}
    for r in aliases.orderBy("concept", "alias").toLocalIterator():
        names.setdefault(r["concept"], []).append(r["alias"])
    out = []
    for c in concepts.orderBy("concept").toLocalIterator():
        entry = {"id": c["concept"], "name": c["name"], "dimension": c["dimension"], "data_type": c["data_type"], "aliases": [a for a in names.get(c["concept"], []) if a != c["name"]]}
        out.append({k: v for k, v in entry.items() if v})
    return yaml.safe_dump({"concepts": out}, allow_unicode=True, sort_keys=False)
