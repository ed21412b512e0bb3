"""Mapping fields to concepts: by names, by similar names, by what the surroundings say, and by the documents' own dictionaries.

fields: field (an id), document, sheet, label, path (header texts, array; the last is the label's own), unit, value (struct of num and text), is_formula, style_role.
concepts: concept, ord (place in the vocabulary), name, dimension, keywords (array), roles (array).  names: concept, name (canonical ones and synonyms).
unit_dimensions: unit (any known spelling), dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celldag.functions.cells import normalize_label
from celldag.operators.matching import sequence_ratio

# Fixed values of the scores.
EXACT, NORMALISED, FUZZY, LEAST_RATIO = 1.0, 0.95, 0.8, 0.55
UNIT_FITS, CONTEXT_HIT, CONTEXT_MISS, ROLE_MISS, LEAST = 0.05, 0.05, 0.25, 0.1, 0.3
AUTO, GAP, PARENT, DICTIONARY = 0.85, 0.05, 0.95, 0.97
# What header texts of dictionary sheets, and their sheets' names, contain (without regard to case), and signs for nothing.
TERM_HEADER = "(?i)용어|개념|concept|tag|column|동의어|표현|alias|symbol|label"
MEANING_HEADER = "(?i)의미|meaning"
UNIT_HEADER = "(?i)단위|unit"
SHEET_NAME = "(?i)코드|사전|dictionary|근거|master|code"
NOTHING = ("", "-")
MOST_SENT = 100_000  # names of a vocabulary that is sent to all tasks; a larger one is shuffled


# Similar names

def characters(texts: DataFrame, key: str) -> DataFrame:
    """(key, n, tokens): each text's characters as `c1` (the first c), `c2` (the second) and so on, so that common characters of two texts are common tokens."""
    signs = texts.select(key, F.length(key).alias("n"), F.posexplode(F.split(key, "")).alias("i", "c")).where("c <> ''")
    numbered = signs.withColumn("k", F.row_number().over(Window.partitionBy(key, "c").orderBy("i")))
    return numbered.select(key, "n", F.concat("c", F.col("k").cast("string")).alias("token"))


def similar(left: DataFrame, right: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """(a, b, ratio): all pairs of texts a of `left` (column a) and b of `right` (column b) whose Ratcliff-Obershelp ratio is `least` or more.

    The ratio is 2 m / (|a| + |b|), and no more characters can match than both have in common.  So a pair that may qualify
    has least / 2 * (|a| + |b|) tokens in common or more; of these, one is among the rarest of a, as b can't be shorter than |a| least / (2 - least).  Texts are joined on
    these few tokens, lengths and common tokens are compared, and only for what is left is the ratio computed.
    """
    a = characters(left.select("a").where("length(a) > 0").distinct(), "a")
    b = characters(right.select("b").where("length(b) > 0").distinct(), "b")
    seen = b.groupBy("token").agg(F.count("*").alias("df"))
    all_a = a.join(seen, "token", "left").groupBy("a", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("ranked"))
    needed = F.ceil(F.col("n") * (least / (2 - least) + 1) * least / 2 - 1e-9).cast("int")
    sets_a = all_a.select("a", F.col("n").alias("n_a"), F.transform("ranked", lambda x: x["token"]).alias("tokens_a"), (F.col("n") - needed + 1).alias("front"))
    sets_b = b.groupBy("b", "n").agg(F.collect_list("token").alias("tokens_b")).withColumnRenamed("n", "n_b")
    shortest, longest = F.col("n_a") * least / (2 - least) - 1e-9, F.col("n_a") * (2 - least) / least + 1e-9
    front = sets_a.select("a", "n_a", F.explode(F.slice("tokens_a", F.lit(1), F.col("front"))).alias("token"))
    met = front.join(b.select("b", F.col("n").alias("n_b"), "token"), "token").where((F.col("n_b") >= shortest) & (F.col("n_b") <= longest)).select("a", "b").distinct()
    common = met.join(sets_a.select("a", "n_a", "tokens_a"), "a").join(sets_b, "b").where(2 * F.size(F.array_intersect("tokens_a", "tokens_b")) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9)
    return common.select("a", "b", sequence_ratio("a", "b").alias("ratio")).where(F.col("ratio") >= least)


def by_name(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(label, concept, base, how) of distinct labels: 1 for an equal name, 0.95 for one that is equal when normalised, else 0.8 times the best ratio."""
    own = labels.select("label").distinct().withColumn("a", normalize_label(F.col("label")))
    known = names.where("length(name) > 0").select("concept", "name").distinct().withColumn("b", normalize_label(F.col("name")))
    exact = own.join(known, F.col("label") == F.col("name")).select("label", "concept", F.lit(EXACT).alias("base"), F.lit("exact").alias("how"))
    same = own.where("length(a) > 0").join(known, F.col("a") == F.col("b")).select("label", "concept", F.lit(NORMALISED).alias("base"), F.lit("normalized").alias("how"))
    pairs = similar(own.select("a"), known.select("b"))
    fuzzy = pairs.join(own, "a").join(known.select("concept", "b"), "b").select("label", "concept", (F.col("ratio") * FUZZY).alias("base"), F.lit("fuzzy").alias("how"))
    return exact.unionByName(same).unionByName(fuzzy).groupBy("label", "concept").agg(F.max("base").alias("base"), F.max_by("how", "base").alias("how"))


# Decisions

def _asked(fields: DataFrame) -> DataFrame:
    """The field's own label (level 0) and, for the case that it stays open, the headers above it, from the nearest on."""
    above = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    own = F.struct(F.lit(0).alias("level"), F.col("label").alias("label"), above.alias("context"))
    parents = F.transform(F.reverse(above), lambda p, i: F.struct((i + 1).cast("int").alias("level"), p.alias("label"), F.slice("path", 1, F.greatest(F.size("path") - 2, F.lit(0))).alias("context")))
    return fields.withColumn("q", F.explode(F.concat(F.array(own), parents))).select("field", "document", "sheet", "unit", "value", "is_formula", "style_role", "q.level", F.col("q.label").alias("label"), F.col("q.context").alias("context"))


def candidates(asked: DataFrame, concepts: DataFrame, names: DataFrame, unit_dimensions: DataFrame) -> DataFrame:
    """(field, level, concept, ord, confidence, how): concepts whose confidence is above 0.3, rounded to 4 places.

    A unit of the concept's dimension adds 0.05; one of another rules it out, be it the field's or part of its value (`180 ℃`); where there is none, so does a value that
    is no number.  Where the concept has keywords, one of them in document, sheet or upper headers adds 0.05, none takes 0.25; a role that it doesn't allow takes 0.1.
    """
    named = asked.join(by_name(asked, names), "label").join(concepts.select("concept", "ord", "dimension", "keywords", "roles"), "concept")
    tail = F.when(F.col("unit").isNull() & ~F.col("is_formula"), F.regexp_extract("value.text", r"^\s*[-+]?\d+(?:\.\d+)?\s*(\S.*?)\s*$", 1))
    spelled = F.trim(F.regexp_replace(F.coalesce("unit", tail), r"\s*@.*$", ""))
    known = unit_dimensions.select(F.col("unit").alias("__u"), F.col("dimension").alias("__d"), F.lit(True).alias("fits")).distinct()
    units = unit_dimensions.select(F.col("unit").alias("__u"), F.lit(True).alias("is_unit")).distinct()
    told = named.withColumn("__u", spelled).join(known.withColumnRenamed("__d", "dimension"), ["__u", "dimension"], "left").join(units, "__u", "left")
    asks, has_unit = F.col("dimension").isNotNull() & (F.col("dimension") != ""), F.col("unit").isNotNull() & (F.col("unit") != "")
    bare = F.col("unit").isNull() & (F.col("dimension") != "time_of_day") & F.col("value.text").isNotNull() & ~F.col("is_formula")
    in_value = bare & F.coalesce("is_unit", F.lit(False))
    fits, checked = F.coalesce("fits", F.lit(False)), asks & (has_unit | in_value)
    no_number = asks & bare & ~in_value & ~F.col("value.text").rlike(r"^[\d.\-+~≥≤<> ]+$")
    kept = told.where(~F.coalesce(checked & ~fits, F.lit(False)) & ~F.coalesce(no_number, F.lit(False)))
    base = F.when(checked & fits, F.least(F.lit(1.0), F.col("base") + UNIT_FITS)).otherwise(F.col("base"))
    around = F.concat_ws(" ", "document", "sheet", "context")
    hit = F.exists("keywords", lambda k: F.contains(around, k))
    in_context = F.when(F.coalesce(F.size("keywords"), F.lit(0)) < 1, base).when(hit, F.least(F.lit(1.0), base + CONTEXT_HIT)).otherwise(base - CONTEXT_MISS)
    odd_role = (F.coalesce(F.size("roles"), F.lit(0)) > 0) & (F.coalesce("style_role", F.lit("unknown")) != "unknown") & ~F.array_contains("roles", F.col("style_role"))
    score = F.when(F.coalesce(odd_role, F.lit(False)), in_context - ROLE_MISS).otherwise(in_context)
    return kept.withColumn("score", score).where(F.col("score") > LEAST).select("field", "level", "concept", "ord", F.round("score", 4).alias("confidence"), "how")


def decide(fields: DataFrame, concepts: DataFrame, names: DataFrame, unit_dimensions: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(field, concept, confidence, decision, via) of every field: `auto` from 0.85 on if no second concept comes within 0.05, else `pending`.

    A field that stays open is mapped by the nearest header above it that is clear, at 0.95 times its confidence, if that is still 0.85 (via: that
    header).  What the document's own dictionary says (dictionary: document, term, concept; terms normalised) goes before all, at 0.97, unless the field's
    unit is of another dimension.
    """
    asked = _asked(fields)
    found = candidates(asked, concepts, names, unit_dimensions)
    best = F.row_number().over(Window.partitionBy("field", "level").orderBy(F.desc("confidence"), "ord"))
    top = found.withColumn("rank", best).where("rank <= 2").groupBy("field", "level").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("concept", "confidence"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("confidence"))).alias("second"))
    clear = (F.col("first.confidence") >= AUTO) & F.coalesce(F.col("second") < F.col("first.confidence") - GAP, F.lit(True))
    judged = asked.select("field", "level", "label").join(top, ["field", "level"]).withColumn("clear", clear)
    lowered = F.round(F.col("first.confidence") * PARENT, 4)
    per = judged.groupBy("field").agg(
        F.max(F.when(F.col("level") == 0, F.struct("first", "clear"))).alias("own"),
        F.min(F.when((F.col("level") > 0) & F.col("clear") & (lowered >= AUTO), F.struct("level", F.col("first.concept").alias("concept"), lowered.alias("confidence"), F.col("label").alias("via")))).alias("parent"),
    )
    out = fields.select("field", "document", "label", "unit").join(per, "field", "left")
    if dictionary is None:
        out = out.withColumn("listed", F.lit(None).cast("string"))
    else:
        terms = dictionary.select("document", F.col("term").alias("__t"), F.col("concept").alias("listed"))
        told = out.withColumn("__t", normalize_label(F.col("label"))).join(terms, ["document", "__t"], "left").join(concepts.select(F.col("concept").alias("listed"), F.col("dimension").alias("__d")), "listed", "left")
        fits = unit_dimensions.select(F.col("unit").alias("__u"), F.col("dimension").alias("__d"), F.lit(True).alias("fits")).distinct()
        bare = F.trim(F.regexp_replace("unit", r"\s*@.*$", ""))
        told = told.withColumn("__u", bare).join(fits, ["__u", "__d"], "left")
        free = F.col("__d").isNull() | (F.col("__d") == "") | F.col("unit").isNull() | (F.col("unit") == "") | F.coalesce("fits", F.lit(False))
        out = told.withColumn("listed", F.when(free, F.col("listed")))
    own_clear, by_parent = F.coalesce("own.clear", F.lit(False)), F.col("parent").isNotNull()
    pick = lambda listed, own, parent, none: F.when(F.col("listed").isNotNull(), listed).when(own_clear, own).when(by_parent, parent).otherwise(none)
    return out.select(
        "field", pick(F.col("listed"), F.col("own.first.concept"), F.col("parent.concept"), F.col("own.first.concept")).alias("concept"),
        pick(F.lit(DICTIONARY), F.col("own.first.confidence"), F.col("parent.confidence"), F.coalesce("own.first.confidence", F.lit(0.0))).alias("confidence"),
        pick(F.lit("auto"), F.lit("auto"), F.lit("auto"), F.lit("pending")).alias("decision"), F.when(F.col("listed").isNull() & ~own_clear & by_parent, F.col("parent.via")).alias("via"),
    )


# Dictionary sheets

def _text() -> Column:
    return F.trim("text")


def dictionary_sheets(cells: DataFrame) -> DataFrame:
    """(document, sheet, header_row) of sheets (cells: document, sheet, row, col, text) that explain terms.

    Their header row, the first with two texts or more, names a column of terms, and columns of terms, units and meanings are three or more; a telling name of the sheet counts as one of them.
    """
    texts = cells.where(_text() != "").select("document", "sheet", "row", "col", _text().alias("t"))
    rows = texts.groupBy("document", "sheet", "row").agg(F.count("*").alias("n"), *[F.count_if(F.col("t").rlike(p)).alias(c) for c, p in (("terms", TERM_HEADER), ("units", UNIT_HEADER), ("meanings", MEANING_HEADER))])
    first = rows.where("n >= 2").groupBy("document", "sheet").agg(F.min_by(F.struct("row", "terms", "units", "meanings"), "row").alias("h")).select("document", "sheet", "h.*")
    score = F.col("terms") + F.col("units") + F.col("meanings") + F.col("sheet").rlike(SHEET_NAME).cast("int")
    return first.where((F.col("terms") >= 1) & (score >= 3)).select("document", "sheet", F.col("row").alias("header_row"))


def dictionary_entries(cells: DataFrame) -> DataFrame:
    """(document, sheet, row, terms, unit) of dictionary sheets: what the columns of terms and meanings list, split at `/`, and the first unit."""
    sheets = dictionary_sheets(cells)
    texts = cells.where(_text() != "").select("document", "sheet", "row", "col", _text().alias("t")).join(sheets, ["document", "sheet"])
    heads = texts.where("row = header_row").select("document", "sheet", "col", (F.col("t").rlike(TERM_HEADER) | F.col("t").rlike(MEANING_HEADER)).alias("of_terms"), F.col("t").rlike(UNIT_HEADER).alias("of_units"))
    body = texts.where("row > header_row").join(heads, ["document", "sheet", "col"]).where(~F.col("t").isin(*NOTHING))
    parts = F.filter(F.split("t", r"\s*/\s*"), lambda x: ~x.isin(*NOTHING))
    rows = body.groupBy("document", "sheet", "row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("of_terms"), F.struct("col", parts.alias("p"))))), lambda x: x["p"])).alias("terms"), F.min_by("t", F.when(F.col("of_units"), F.col("col"))).alias("unit"))
    return rows.where("size(terms) > 0")


def _sent(df: DataFrame, few: bool) -> DataFrame:
    """For a join: sent to all tasks if it is small, else shuffled."""
    return F.broadcast(df) if few else df.hint("merge")


def dictionary_terms(entries: DataFrame, names: DataFrame, concepts: DataFrame) -> DataFrame:
    """(document, term, concept): normalised terms of entries in which some term names a concept.

    First the terms as they stand are tried in order, then normalised, then without what stands in brackets at their end.  Of several entries with one term, the first says what it is; of several concepts with one name, the vocabulary's first.
    """
    few = names.count() <= MOST_SENT  # Spark tells a table's size by its files, where names are packed
    order = concepts.select("concept", "ord")
    listed = names.where("length(name) > 0").join(_sent(order, few), "concept")
    first = lambda of, key, exact: of.groupBy(F.col(key).alias("key")).agg(F.min_by("concept", "ord").alias("c")).withColumn("exact", F.lit(exact))
    loose = listed.withColumn("norm", normalize_label(F.col("name"))).where("length(norm) > 0")
    known = first(listed, "name", True).unionByName(first(loose, "norm", False))
    each = entries.select("document", "sheet", "row", F.posexplode("terms").alias("i", "term"))
    cut = F.trim(F.regexp_replace("term", r"\s*\([^)]*\)\s*$", ""))
    each = each.withColumns({"norm": normalize_label(F.col("term")), "cut": F.when((cut != "") & (cut != F.col("term")), cut)}).withColumn("cut_norm", normalize_label(F.col("cut")))
    ways = [F.when(F.length(c) > 0, F.struct(F.lit(w).alias("way"), F.lit(w % 2 == 0).alias("exact"), F.col(c).alias("key"))) for w, c in enumerate(("term", "norm", "cut", "cut_norm"))]
    tries = each.select("document", "sheet", "row", "i", F.explode(F.array_compact(F.array(*ways))).alias("t")).select("document", "sheet", "row", "i", "t.*")
    hit = F.when(F.col("c").isNotNull(), F.struct(F.least("way", F.lit(2)).alias("tier"), "i", "way", "c"))
    found = tries.join(_sent(known, few), ["exact", "key"], "left").withColumn("concept", F.min(hit).over(Window.partitionBy("document", "sheet", "row"))["c"])
    terms = found.where("way = 1 and concept is not null").withColumnRenamed("key", "term")
    return terms.groupBy("document", "term").agg(F.min_by("concept", F.struct("sheet", "row", "i")).alias("concept"))
