"""Joins, votes, rankings and roll-ups that the metadata reports are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a partner (a null key has none)."""
    return left.join(right.select(*on), on, "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows per key in the given order, which should be total."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def occurrence_keys(df: DataFrame, keys: list[str], base: str, order: list[Column], out: str = "key") -> DataFrame:
    """`base`, from its second time on within keys with #1, #2 and so on."""
    n = F.row_number().over(Window.partitionBy(*keys, base).orderBy(*order)) - 1
    return df.withColumn("__n", n).withColumn(out, F.when(F.col("__n") == 0, F.col(base)).otherwise(F.concat_ws("#", base, F.col("__n").cast("string")))).drop("__n")


def two_tier_vote(votes: DataFrame, keys: list[str], choice: str, human: Column) -> DataFrame:
    """(keys, winner, tier, support, total, dissent): human votes overrule automatic ones; a tie has no winner.

    dissent: the other choices of the deciding tier, sorted; on a tie all of them.
    """
    tiers = votes.withColumn("tier", F.when(human, "human").otherwise("auto"))
    counts = tiers.groupBy(*keys, "tier", choice).agg(F.count("*").alias("n"))
    decided = counts.groupBy(*keys).agg(F.max("tier").alias("tier"))  # "human" sorts after "auto"
    inside = counts.join(decided, [*keys, "tier"])
    per_key = inside.groupBy(*keys, "tier").agg(F.max("n").alias("support"), F.sum("n").alias("total"), F.collect_list(F.struct("n", F.col(choice).alias("c"))).alias("all"))
    best = F.transform(F.filter("all", lambda x: x["n"] == F.col("support")), lambda x: x["c"])
    winner = F.when(F.size(best) == 1, best[0])
    rest = F.filter(F.transform("all", lambda x: x["c"]), lambda c: ~c.eqNullSafe(winner))
    return per_key.select(*keys, winner.alias("winner"), "tier", "support", "total", F.array_join(F.array_sort(rest), ",").alias("dissent"))


def mode_first(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Each key's most common value that isn't null; of equally common ones the first seen, then the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), "first", value)).alias(value), F.max("n").alias("n"))


def representatives(df: DataFrame, keys: list[str], value: str, order: Column, k: int = 4) -> DataFrame:
    """Each key's first k distinct values that aren't null, in order, as text joined by |."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("at"))
    ranked = top_k(first, keys, [F.col("at")], k)
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(value).cast("string").alias("v")))), lambda x: x["v"]), "|").alias("values"))


def inferred_type(num: Column, text: Column) -> Column:
    """Aggregate: numeric or text if 80 % of what isn't null is, empty if nothing is there, else mixed."""
    n, t = F.count(num), F.count(F.when(num.isNull(), text))
    return F.when(n + t == 0, "empty").when(n * 5 >= (n + t) * 4, "numeric").when(t * 5 >= (n + t) * 4, "text").otherwise("mixed")


def membership(derived: DataFrame, included: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Derived and included keys, without the excluded ones."""
    return derived.select(key).unionByName(included.select(key)).distinct().join(excluded.select(key), key, "left_anti")


def match_percent(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """(group, keys, hits, pct): which share of each group's distinct keys is in right; groups without a hit are left out."""
    mine = left.select(group, key).distinct()
    hit = mine.join(right.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    out = hit.groupBy(group).agg(F.count("*").alias("keys"), F.sum(F.coalesce("__hit", F.lit(0))).alias("hits"))
    return out.where("hits > 0").withColumn("pct", F.round(F.col("hits") * 100.0 / F.col("keys"), 1))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges that hold them (ends included), as an equi-join on bins of the given width."""
    binned = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    keyed = points.withColumn("__bin", F.floor(F.col(point) / width))
    return keyed.join(binned, "__bin").where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at_left: str, at_right: str, right_id: str) -> DataFrame:
    """Each left row's nearest right row of the same keys: least distance, then the earlier, then the smaller id; null without any.

    Both sides are laid out once in order; each row looks back and ahead, so no pairs are made; the second layout is the first one's reverse.
    """
    columns = left.columns
    l = left.withColumns({"__at": F.col(at_left), "__p": F.lit(None).cast("struct<at:double,id:bigint>"), "__side": F.lit(1)})
    r = right.select(*keys, F.col(at_right).alias("__at"), F.struct(F.col(at_right).cast("double").alias("at"), F.col(right_id).cast("bigint").alias("id")).alias("__p"))
    r = r.groupBy(*keys, "__at").agg(F.min("__p").alias("__p")).withColumn("__side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("__at", "__side")
    back = F.last("__p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    falling = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc("__side"))
    ahead = F.last("__p", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0))  # a running value, as a frame that shrinks would be read anew for each row
    seen = both.withColumns({"__b": back, "__a": ahead}).where("__side = 1")
    at = F.col("__at").cast("double")
    closer = F.when(F.col("__a").isNull() | (at - F.col("__b.at") <= F.col("__a.at") - at), F.col("__b")).otherwise(F.col("__a"))
    chosen = F.when(F.col("__b").isNull(), F.col("__a")).otherwise(closer)
    return seen.select(*columns, chosen["id"].alias(right_id), F.abs(chosen["at"] - at).alias("distance"))


def islands(df: DataFrame, keys: list[str], at: str, gap: int = 1) -> DataFrame:
    """Adds `island`: rows of a key stay together while `at` grows by at most `gap`; numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(at)
    starts = (F.col(at) - F.lag(at).over(order) > gap).cast("int")
    return df.withColumn("__s", F.coalesce(starts, F.lit(1))).withColumn("island", F.sum("__s").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("__s")


def spans(headers: DataFrame, keys: list[str], at: str, last: Column) -> DataFrame:
    """Adds top, content_top and bottom: a header's block reaches to the next header, the last one's to the end."""
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    return headers.withColumns({"top": F.col(at), "content_top": F.col(at) + 1, "bottom": F.coalesce(following - 1, last)})


def unpivot(df: DataFrame, ids: list[str], measures: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    """Wide to long, without cells that are null."""
    return df.unpivot(ids, measures, name, value).where(F.col(value).isNotNull())


def pivot(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide for known names; several values of one cell are summed."""
    return df.groupBy(*keys).pivot(name, names).agg(F.sum(value))


def status_counts(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """Per key: total, n_<value> for each status, and coverage: the first value's share in %, null without rows."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values]
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *counts).withColumn("coverage", F.round(F.try_divide(F.col(f"n_{values[0].lower()}") * 100.0, F.col("total")), 2))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
