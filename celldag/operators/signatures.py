"""Signatures of row sets that are kept up to date from changes alone.

A row's SHA-256 is read as eight numbers of 32 bits; a set's sums are these numbers added up over its rows, each modulo 2**32.  Sums don't depend on the rows' order or place, count repeated rows as often as they are
there, and take rows in and out: after a change only the rows that came and went are read.  They tell accidental changes apart like a hash of 256 bits, but, being sums, aren't made to withstand rows forged to collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8
MODULUS = 1 << 32


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns' values as text, each by its length, or `-` for null: no two different rows are written alike."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def _lanes(h: Column) -> list[Column]:
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(LANES)]


def _added(lanes: list[Column]) -> Column:
    return F.array(*[F.pmod(F.sum(x), F.lit(MODULUS)) for x in lanes])


def sums(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(*keys, n, lanes): the sums of each set of rows, in one grouping with partial sums before the shuffle, so that a hot key costs no more than others.

    A set may have up to 2**31 rows; beyond, the sum of longs raises.  Null keys form a set; an empty table has none.
    """
    hashed = rows.select(*keys, row_hash(columns).alias("__h"))
    return hashed.groupBy(*keys).agg(F.count("*").alias("n"), _added(_lanes(F.col("__h"))).alias("lanes"))


def update(kept: DataFrame, added: DataFrame, removed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The sums after rows came and went, from the kept sums and these rows; sets without rows left are gone.

    A changed row is removed as it was and added as it is.
    """
    gone = sums(removed, keys, columns).select(*keys, (-F.col("n")).alias("n"), F.transform("lanes", lambda x: -x).alias("lanes"))
    parts = kept.select(*keys, "n", "lanes").unionByName(sums(added, keys, columns)).unionByName(gone)
    total = parts.groupBy(*keys).agg(F.sum("n").alias("n"), _added([F.col("lanes")[i] for i in range(LANES)]).alias("lanes"))
    return total.where("n <> 0 or exists(lanes, x -> x <> 0)")


def hexed(lanes: Column) -> Column:
    """The sums as 64 hex digits."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def overall(kept: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n, signature): a signature of all sets together, from their sums alone; of no sets, 64 zeros."""
    h = kept.select(*keys, "n", hexed(F.col("lanes")).alias("__s")).select("n", row_hash([*keys, "n", "__s"]).alias("__h"))
    lanes = F.array(*[F.pmod(F.coalesce(F.sum(x), F.lit(0)), F.lit(MODULUS)) for x in _lanes(F.col("__h"))])
    return h.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), hexed(lanes).alias("signature"))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, state): added, removed, changed or same, by comparing sums."""
    a, b = (d.select(*keys, F.struct("n", "lanes").alias(s)) for d, s in ((old, "__a"), (new, "__b")))
    joined = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") == F.col("__b"), "same").otherwise("changed")
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], state.alias("state"))
