"""Versions: tree diffs, slowly changing records, upserts, as joins of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semantic_fingerprint(*parts: Column) -> Column:
    """SHA-256 over what a node means (type, path, name, unit), as a JSON array, so that neither nulls nor separators in the parts make two nodes equal."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def diff(before: DataFrame, after: DataFrame, key: str, semantic: str, content: str) -> DataFrame:
    """(key, action) of each node of two versions: unchanged, content, changed, added, revived or removed.

    before has a column status (ACTIVE or REMOVED); nodes that were and stay removed are left out.
    """
    b = before.select(key, F.col(semantic).alias("s0"), F.col(content).alias("c0"), F.col("status").alias("st"))
    a = after.select(key, F.col(semantic).alias("s1"), F.col(content).alias("c1"), F.lit(True).alias("here"))
    return b.join(a, key, "full").select(key, _action().alias("action")).where("action is not null")


def _action() -> Column:
    return (
        F.when(F.col("st").isNull(), "added").when(F.col("here").isNull() & (F.col("st") == "ACTIVE"), "removed").when(F.col("here").isNull(), None)
        .when(F.col("st") == "REMOVED", "revived").when(~F.col("s0").eqNullSafe(F.col("s1")), "changed").when(~F.col("c0").eqNullSafe(F.col("c1")), "content").otherwise("unchanged")
    )


def diff_together(both: DataFrame, keys: list[str], after: Column, semantic: str, content: str) -> DataFrame:
    """The same (keys, action) of nodes of two versions in one table, all of them active; after: whether a row is of the later one.

    Rows that lie by one of the keys already are not shuffled for it.
    """
    first = lambda of, c: F.max(F.when(of, c))
    seen = both.groupBy(*keys).agg(
        first(~after, F.lit("ACTIVE")).alias("st"), first(after, F.lit(True)).alias("here"), first(~after, F.col(semantic)).alias("s0"), first(after, F.col(semantic)).alias("s1"), first(~after, F.col(content)).alias("c0"), first(after, F.col(content)).alias("c1")
    )
    return seen.select(*keys, _action().alias("action"))


def scd2(current: DataFrame, incoming: DataFrame, key: str, columns: list[str], at: Column) -> DataFrame:
    """The next state of a record table with (key, columns, valid_from, valid_to, is_current).

    A changed record's current row is closed and a new one opened; new keys are opened; current
    rows whose key doesn't come again are closed; unchanged ones and history stay.
    """
    history = current.where("not is_current")
    to = current.schema["valid_to"].dataType
    plain = lambda c: F.to_json(c) if "map<" in current.schema[c.split(".")[1]].dataType.simpleString() else F.col(c)  # noqa: E731  maps can't be compared
    old = current.where("is_current").select(key, F.struct(*columns).alias("__o"), "valid_from", "valid_to")
    new = incoming.select(key, F.struct(*columns).alias("__n"))
    # Both sides meet once: a pair tells what closes and what opens.
    met = old.join(new, key, "full")
    equal = F.col("__o").isNotNull() & F.col("__n").isNotNull()
    for c in columns:
        equal = equal & plain(f"__o.{c}").eqNullSafe(plain(f"__n.{c}"))
    row = lambda side, since, until, now: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns], since.alias("valid_from"), until.alias("valid_to"), now.alias("is_current"))
    kept = F.when(F.col("__o").isNotNull(), row("__o", F.col("valid_from"), F.when(equal, F.col("valid_to")).otherwise(at), equal))
    opened = F.when(F.col("__n").isNotNull() & ~equal, row("__n", at, F.lit(None).cast(to), F.lit(True)))
    out = met.select(key, F.explode(F.array_compact(F.array(kept, opened))).alias("__r")).select(key, "__r.*")
    return history.select(*out.columns).unionByName(out)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of changes replace or join those of table, by key."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet are added."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def to_ingest(files: DataFrame, ingested: DataFrame, parser: str) -> DataFrame:
    """Files (path, hash) that this parser version hasn't read in this very content."""
    done = ingested.where(F.col("parser") == parser).select("path", "hash")
    return files.join(done, ["path", "hash"], "left_anti")


def effective_mappings(template: DataFrame, overrides: DataFrame) -> DataFrame:
    """Template mappings (template, sheet, key, source), each replaced by its latest override of status APPROVED or CONFLICT."""
    ranked = overrides.where(F.col("status").isin("APPROVED", "CONFLICT")).groupBy("template", "sheet", "key").agg(F.max_by("source", F.struct("updated_at", "override_id")).alias("o"))
    return template.join(ranked, ["template", "sheet", "key"], "left").select("template", "sheet", "key", F.coalesce("o", "source").alias("source"), F.col("o").isNotNull().alias("overridden"))
