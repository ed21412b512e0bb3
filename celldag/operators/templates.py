"""Parsing templates and vocabulary surveys: which sheets a template reads, what a version change does, what labels lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldag.functions.cells import normalize_label


def route_sheets(cells: DataFrame, rules: DataFrame, corner: int = 30) -> DataFrame:
    """(template, sheet) of every match: the sheet's name is listed, or fits the pattern, or one of the headers stands in its first
    `corner` rows and columns.  rules: template, names (array), pattern, headers (array); nulls and empty lists match nothing."""
    sheets = cells.select("sheet").distinct()
    named = sheets.join(rules.select("template", F.explode("names").alias("sheet")), "sheet").select("template", "sheet")
    patterns = rules.where("pattern is not null and pattern <> ''").select("template", "pattern")
    fitting = sheets.join(F.broadcast(patterns), F.expr("sheet rlike pattern")).select("template", "sheet")  # one row per template
    heads = cells.where((F.col("row") <= corner) & (F.col("col") <= corner)).select("sheet", normalize_label(F.col("text")).alias("h"))
    wanted = rules.select("template", F.explode("headers").alias("t")).select("template", normalize_label(F.col("t")).alias("h"))
    headed = heads.join(wanted, "h").select("template", "sheet")
    return named.unionByName(fitting).unionByName(headed).distinct()


def version_audit(overrides: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Overrides (template, sheet, key, source, ...) with their status after a version change: REDUNDANT where the new version says
    the same, CONFLICT where it changed what the override was made against or dropped it, else APPROVED."""
    keys = ["template", "sheet", "key"]
    o, n = old.select(*keys, F.col("source").alias("was")), new.select(*keys, F.col("source").alias("will"))
    met = overrides.join(o, keys, "left").join(n, keys, "left")
    status = F.when(F.col("source").eqNullSafe(F.col("will")), "REDUNDANT").when(~F.col("was").eqNullSafe(F.col("will")), "CONFLICT").otherwise("APPROVED")
    return met.withColumn("status", status).drop("was", "will")


def run_status(extracted: DataFrame) -> DataFrame:
    """(run, total, failed, warnings, status) of extracted values (run, ok, warning): SUCCESS without warnings or failures, FAILED if all failed, else REVIEW_REQUIRED."""
    counts = extracted.groupBy("run").agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("failed"), F.count("warning").alias("warnings"))
    status = F.when(F.col("failed") == F.col("total"), "FAILED").when((F.col("warnings") == 0) & (F.col("failed") == 0), "SUCCESS").otherwise("REVIEW_REQUIRED")
    return counts.withColumn("status", status)


def survey_labels(observations: DataFrame, samples: int = 3) -> DataFrame:
    """Per normalised label: n, n_auto, kind (known, ambiguous, or unknown where there is no candidate), units, up to `samples` values, the top candidate.

    observations: label, unit, value, status, candidate, score.  Samples are the first values in order.
    """
    rows = observations.withColumn("norm", normalize_label(F.col("label")))
    per = rows.groupBy("norm").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "AUTO_APPROVED").alias("n_auto"), F.array_sort(F.collect_set("unit")).alias("units"),
        F.max_by("candidate", F.struct("score", "candidate")).alias("top"),
    )
    values = rows.where("value is not null").select("norm", "value").distinct()
    first = values.groupBy("norm").agg(F.slice(F.array_sort(F.collect_set("value")), 1, samples).alias("samples"))
    kind = F.when(F.col("n_auto") == F.col("n"), "known").when(F.col("top").isNull(), "unknown").otherwise("ambiguous")
    return per.join(first, "norm", "left").withColumn("kind", kind)
