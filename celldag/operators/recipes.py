"""Applying a recipe to the nodes of new documents, and proposing the fields that chosen nodes make together.

A recipe's entries are few beside the nodes, so what belongs to an entry (its concept's name, type and
status, the names of dissenting concepts) is joined to it once; nodes then meet entries in two equi-joins,
by their exact keys and, where these have none, by keys whose paths leave the layout out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of nodes that take a mapping, and types of a node and a concept that don't go together.
MAPPABLE = ("HEADER", "SUB_HEADER")
INCOMPATIBLE = (("numeric", "text"), ("numeric", "category"), ("text", "numeric"), ("text", "datetime"))

#: A segment of a region, its layout's fingerprint and number behind its kind (a fixed form).
LAYOUT = r"(^|/)([A-Z_]+):[0-9a-f]*#\d+(?=/|$)"

KEY = ("path", "type", "name")


def path_without_layout(path: Column) -> Column:
    """The path without the fingerprints and numbers that its regions' segments carry (TABLE:3fa9#1 becomes TABLE), as these change with a layout."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), LAYOUT, "$1$2")


def incompatible(node: Column, concept: Column) -> Column:
    """Types that don't go together; unknown ones do."""
    return F.coalesce(F.array_contains(F.array(*[F.lit(f"{a}/{b}") for a, b in INCOMPATIBLE]), F.concat(node, F.lit("/"), concept)), F.lit(False))


def entries(template: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row per exact key with what its concept says.

    template: path, type, name, concept, tier, support, total, dissent (array of concept, support; may be null).
    concepts: concept, canonical_name, data_type, status.
    Of repeated keys the one with most support stays, then the smallest concept.  An unknown concept is as one that isn't active.
    """
    best = template.groupBy(*KEY).agg(F.min_by(F.struct("concept", "tier", "support", "total", "dissent"), F.struct(-F.col("support"), "concept")).alias("e")).select(*KEY, "e.*").withColumn("entry", F.xxhash64(F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"})))
    known = concepts.dropDuplicates(["concept"]).select("concept", "canonical_name", F.col("data_type").alias("concept_type"), F.col("status").eqNullSafe("ACTIVE").alias("active"))
    others = best.select(*KEY, F.posexplode("dissent").alias("at", "d")).select(*KEY, "at", F.col("d.concept").alias("concept"), F.col("d.support").alias("votes"))
    named = others.join(known, "concept", "left").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "concept", F.coalesce("canonical_name", "concept").alias("canonical_name"), "votes"))).alias("others"))
    whole = best.drop("dissent").join(known, "concept", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    same = [whole[k].eqNullSafe(named[k]) for k in KEY]
    return whole.join(named, same, "left").select(*[whole[c] for c in whole.columns], F.coalesce(named["others"], F.array().cast(named.schema["others"].dataType)).alias("others"))


def apply(nodes: DataFrame, template: DataFrame, concepts: DataFrame, recipe: str = "", relaxed: Callable[[Column], Column] = path_without_layout) -> DataFrame:
    """(document, node, concept, match, outcome, confidence, status, reason, candidates) of every mappable node that is mapped already or that an entry fits.

    nodes: document, node, path, type, name, data_type, mapped (has an active mapping).  template, concepts: as in `entries`.
    match: exact, or relaxed where no exact key fits and one entry only has the relaxed key.  outcome: skipped_mapped; skipped_stale
    (the concept isn't active or unknown); review for relaxed matches (0.6), dissent (support by total, to three places, half up) and
    types that don't go together (0.6), in this order; else applied (1.0 if people approved the entry, 0.9 otherwise).
    Null keys equal each other.  Repeated nodes come out as often as they come in; further columns are ignored.
    """
    known = entries(template, concepts)
    given = nodes.where(F.col("type").isin(*MAPPABLE)).select("document", "node", *KEY, "data_type", F.coalesce("mapped", F.lit(False)).alias("mapped"))
    mapped = given.where("mapped").select("document", "node", *[F.lit(None).cast(t).alias(c) for c, t in (("concept", "string"), ("match", "string"))], F.lit("skipped_mapped").alias("outcome"),
        F.lit(None).cast("double").alias("confidence"), *[F.lit(None).cast("string").alias(c) for c in ("status", "reason")], F.lit(None).cast("array<struct<concept:string,canonical_name:string,score:double,signal:string>>").alias("candidates"))
    exact = known.select(F.struct(*[c for c in known.columns if c not in KEY]).alias("e"), *[F.col(k).alias(f"e_{k}") for k in KEY])
    alike = exact.groupBy(relaxed(F.col("e_path")).alias("r_path"), F.col("e_type").alias("r_type"), F.col("e_name").alias("r_name")).agg(F.count("*").alias("n"), F.first("e").alias("r")).where("n = 1").drop("n")
    open_ = given.where("not mapped")
    first = open_.join(exact, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in KEY], "left")
    both = first.join(alike, F.col("e").isNull() & relaxed(F.col("path")).eqNullSafe(F.col("r_path")) & F.col("type").eqNullSafe(F.col("r_type")) & F.col("name").eqNullSafe(F.col("r_name")), "left")
    hit = both.where("e is not null or r is not null").select("document", "node", "data_type", F.when(F.col("e").isNotNull(), "exact").otherwise("relaxed").alias("match"), F.coalesce("e", "r").alias("e")).select("document", "node", "data_type", "match", "e.*")
    share = F.round(F.col("support") / F.col("total"), 3)
    stale, loose, dissent = ~F.col("active"), F.col("match") == "relaxed", F.size("others") > 0
    clash = incompatible(F.col("data_type"), F.col("concept_type"))
    votes = F.format_string("recipe %s: %d of %d (%s)", F.lit(recipe), F.col("support"), F.col("total"), F.col("tier"))
    why = F.when(loose, F.concat(votes, F.lit(", layout changed"))).when(dissent, F.concat(votes, F.lit(", documents disagree"))).when(clash, F.concat(votes, F.lit(", types "), F.col("data_type"), F.lit(" and "), F.col("concept_type"))).otherwise(votes)
    outcome = F.when(stale, "skipped_stale").when(loose | dissent | clash, "review").otherwise("applied")
    confidence = F.when(loose, 0.6).when(dissent, share).when(clash, 0.6).when(F.col("tier") == "APPROVED", 1.0).otherwise(0.9)
    one = F.array(F.struct("concept", "canonical_name", share.alias("score"), F.concat(F.col("tier"), F.lit("/"), F.col("match")).alias("signal")))
    rest = F.transform("others", lambda o: F.struct(o["concept"].alias("concept"), o["canonical_name"].alias("canonical_name"), F.round(o["votes"] / F.col("total"), 3).alias("score"), F.lit("dissent").alias("signal")))
    live = lambda c: F.when(~stale, c)
    found = hit.select("document", "node", "concept", "match", outcome.alias("outcome"), live(confidence).alias("confidence"),
        live(F.when(loose | dissent | clash, "REVIEW_REQUIRED").otherwise("AUTO_APPROVED")).alias("status"), live(why).alias("reason"), live(F.concat(one, rest)).alias("candidates"))
    return found.unionByName(mapped)


def summary(applied: DataFrame) -> DataFrame:
    """Per document: applied, review (relaxed ones among them), skipped_mapped, skipped_stale."""
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return applied.groupBy("document").agg(of("applied"), of("review"), F.count_if((F.col("outcome") == "review") & (F.col("match") == "relaxed")).alias("relaxed"), of("skipped_mapped"), of("skipped_stale"))


def _usable(nodes: DataFrame, mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Active nodes with the first of their mappings (by concept) whose concept exists."""
    known = concepts.dropDuplicates(["concept"]).select("concept", "canonical_name", "name_en", F.col("unit").alias("target_unit"), F.col("data_type").alias("concept_type"))
    live = nodes.where("status = 'ACTIVE'").select("node", "document", F.col("unit").alias("node_unit")).dropDuplicates(["node"])
    first = mappings.select("node", "concept", "status").join(known.where("canonical_name is not null"), "concept").groupBy("node").agg(F.min(F.struct("concept", "status", "canonical_name", "name_en", "target_unit", "concept_type")).alias("m"))
    return live.join(first, "node").select("node", "document", "node_unit", "m.*")


def proposal(chosen: DataFrame, nodes: DataFrame, mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row per concept that the chosen nodes are mapped to: concept, concept_name, field_name, target_unit, data_type, units, sources, review, documents, status, note.

    chosen: node (repeats count once).  nodes: node, document, status, unit.  mappings: node, concept, status (active ones only).
    concepts: concept, canonical_name, name_en, unit, data_type.  Approved mappings are sources, others wait for a review.
    status: REVIEW where some wait, or units differ and the concept has none of its own; else OK.  `stale` gives the chosen nodes that take no part.
    """
    rows = chosen.select("node").distinct().join(_usable(nodes, mappings, concepts), "node")
    approved = F.coalesce(F.col("status").isin("AUTO_APPROVED", "APPROVED"), F.lit(False))
    # Partly aggregated by unit before a concept's rows meet, so a concept with most of the nodes is a few rows per task.
    out = rows.groupBy("concept").agg(
        F.first("canonical_name").alias("concept_name"), F.first("name_en").alias("name_en"), F.first("target_unit").alias("target_unit"), F.first("concept_type").alias("data_type"),
        F.array_sort(F.collect_set(F.when(F.col("node_unit") != "", F.col("node_unit")))).alias("units"), F.count_if(approved).alias("sources"), F.count_if(~approved).alias("review"), F.count_distinct("document").alias("documents"),
    )
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(F.when(F.col("name_en") != "", F.col("name_en")), F.col("concept")))), "[^A-Za-z0-9_]", "_")
    has = F.coalesce(F.col("target_unit") != "", F.lit(False))
    several, listed = F.size("units") > 1, F.array_join("units", "/")
    note = F.when(has & (several | (F.size("units") == 1) & (F.get("units", F.lit(0)) != F.col("target_unit"))), F.concat(listed, F.lit(" to "), F.col("target_unit"))).when(has, F.concat(F.lit("all in "), F.col("target_unit"))).otherwise(F.lit("types made equal"))
    waits = F.when((F.col("review") > 0) & (F.col("sources") == 0), F.format_string("%d to review before they take part", "review")).when(F.col("review") > 0, F.concat(note, F.format_string("; %d to review left out", "review"))).otherwise(note)
    state = F.when((F.col("review") > 0) | several & ~has, "REVIEW").otherwise("OK")
    return out.select("concept", "concept_name", F.when(plain != "", plain).otherwise(F.col("concept")).alias("field_name"), "target_unit", "data_type", "units", "sources", "review", "documents", state.alias("status"), waits.alias("note"))


def stale(chosen: DataFrame, nodes: DataFrame, mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """(node, reason) of chosen nodes that a proposal leaves out: gone (unknown or not active), unmapped, or unknown concept."""
    asked = chosen.select("node").distinct()
    left = asked.join(_usable(nodes, mappings, concepts).select("node"), "node", "left_anti")
    here = nodes.where("status = 'ACTIVE'").select("node", F.lit(True).alias("here")).distinct()
    mapped = mappings.where("concept is not null").select("node", F.lit(True).alias("mapped")).distinct()
    why = F.when(F.col("here").isNull(), "gone").when(F.col("mapped").isNull(), "unmapped").otherwise("unknown concept")
    return left.join(here, "node", "left").join(mapped, "node", "left").select("node", why.alias("reason"))
