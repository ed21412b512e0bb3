"""Matching labels to concepts: candidate signals, judging, string similarity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celldag.functions.cells import normalize_label


def bigrams(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, g): two-character pieces of the first key's normalised label (letters, digits, Hangul and unit signs); a single character is its own piece."""
    plain = df.select(*keys, normalize_label(F.col(keys[0])).alias("__n")).select(*keys, F.regexp_replace("__n", r"[^0-9a-z가-힣%℃°]+", "").alias("__n")).where("length(__n) > 0")
    placed = plain.select(*keys, "__n", F.explode(F.sequence(F.lit(1), F.greatest(F.length("__n") - 1, F.lit(1)))).alias("__i"))
    return placed.select(*keys, F.substring(F.col("__n"), F.col("__i"), F.lit(2)).alias("g"))


def cosine_pairs(labels: DataFrame, aliases: DataFrame, least: float = 0.45) -> DataFrame:
    """(label, concept, alias, cos): bigram cosine of labels and aliases that share a piece, from `least` up.

    Pieces are joined, so labels are never paired with aliases that share nothing with them.
    """
    counts = lambda df, key: bigrams(df, key).groupBy(*key, "g").agg(F.count("*").alias("n"))
    left = counts(labels.select("label").distinct(), ["label"])
    right = counts(aliases.select("alias", "concept").distinct(), ["alias", "concept"])
    size = lambda df, key, out: df.groupBy(*key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(out))
    dot = left.withColumnRenamed("n", "a").join(right.withColumnRenamed("n", "b"), "g").groupBy("label", "alias", "concept").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    cos = dot.join(size(left, ["label"], "l"), "label").join(size(right, ["alias", "concept"], "r"), ["alias", "concept"])
    return cos.select("label", "concept", "alias", (F.col("dot") / (F.col("l") * F.col("r"))).alias("cos")).where(F.col("cos") >= least)


def retrieve(nodes: DataFrame, aliases: DataFrame, concepts: DataFrame, unit_dimensions: DataFrame, k: int = 5) -> DataFrame:
    """(node, concept, score, unit_conflict, rank): at most k concepts per node.

    Signals: +1 for an equal alias, +0.55 per equal parent header, +0.65 times the best alias
    cosine; unit of the concept's dimension +0.15, else -0.45; agreeing data type +0.05, else -0.3.
    Scores above 0.2 stay; ties go to the smaller concept.  nodes: node, label, parents
    (array), unit, data_type.  concepts: concept, dimension, data_type, active.
    """
    norm = aliases.select(normalize_label(F.col("alias")).alias("norm"), "concept").distinct()
    own = nodes.select("node", normalize_label(F.col("label")).alias("norm")).join(norm, "norm").select("node", "concept", F.lit(1.0).alias("s"))
    above = nodes.select("node", F.explode("parents").alias("p")).select("node", normalize_label(F.col("p")).alias("norm")).join(norm, "norm").select("node", "concept", F.lit(0.55).alias("s"))
    best = cosine_pairs(nodes, aliases).groupBy("label", "concept").agg(F.max("cos").alias("cos"))
    lexical = nodes.select("node", "label").join(best, "label").select("node", "concept", (F.col("cos") * 0.65).alias("s"))
    base = own.unionByName(above).unionByName(lexical).groupBy("node", "concept").agg(F.sum("s").alias("s"))
    told = base.join(concepts.where("active").select("concept", "dimension", F.col("data_type").alias("wanted")), "concept").join(nodes.select("node", "unit", "data_type"), "node")
    fits = told.join(unit_dimensions.select("unit", "dimension", F.lit(True).alias("fits")), ["unit", "dimension"], "left")
    asked = F.col("unit").isNotNull() & (F.col("unit") != "") & F.col("dimension").isNotNull()
    unit = F.when(asked & F.col("fits").isNotNull(), 0.15).when(asked, -0.45).otherwise(0.0)
    typed = F.col("wanted").isNotNull() & F.col("data_type").isNotNull() & (F.col("data_type") != "empty")
    agree = ((F.col("wanted") == "numeric") == (F.col("data_type") == "numeric")) | (F.col("data_type") == "mixed")
    kind = F.when(typed & agree, 0.05).when(typed, -0.3).otherwise(0.0)
    scored = fits.select("node", "concept", (F.col("s") + unit + kind).alias("score"), (asked & F.col("fits").isNull()).alias("unit_conflict")).where("score > 0.2")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "concept"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def judge(candidates: DataFrame, nodes: DataFrame, auto: float = 0.85, gap: float = 0.12) -> DataFrame:
    """(node, concept, confidence, status) of every node: confidence is score / 1.15 within 0 and 1.

    A unit conflict, low confidence or a close second asks for review; no candidate leaves a node UNMAPPED.
    """
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 1.15))
    ranked = candidates.withColumn("confidence", conf)
    following = F.lead("confidence").over(Window.partitionBy("node").orderBy("rank"))
    first = ranked.withColumn("second", following).where("rank = 1")
    sure = ~F.col("unit_conflict") & (F.col("confidence") >= auto) & (F.col("confidence") - F.coalesce("second", F.lit(0.0)) >= gap)
    out = nodes.select("node").join(first.withColumn("sure", sure), "node", "left")
    return out.select("node", "concept", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("concept").isNull(), "UNMAPPED").when(F.col("sure"), "AUTO_APPROVED").otherwise("REVIEW_REQUIRED").alias("status"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; null if either is.  Meant for distinct pairs: Spark has no function for it."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")
