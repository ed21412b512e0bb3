"""What people and later runs change: recipes and their versions, reviews, recrawls, releases, groups of documents.

Every state is a table; each function takes tables and returns the next state or a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celldag.operators.relational import two_tier_vote


def next_versions(df: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """(keys, next): one more than the highest version; a key whose versions are all null starts at 1."""
    return df.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next"))


def snapshot(votes: DataFrame, human: Column) -> DataFrame:
    """Recipe entries from approved mappings (recipe, path, concept): (recipe, path, winner, tier, support, total, state).

    Human votes overrule automatic ones.  state: template where all agree, conflict where the winner
    had rivals, dropped where the first two are equal (winner null).  Rows without concept don't vote.
    """
    decided = two_tier_vote(votes.where("concept is not null"), ["recipe", "path"], "concept", human)
    state = F.when(F.col("winner").isNull(), "dropped").when(F.col("support") < F.col("total"), "conflict").otherwise("template")
    return decided.select("recipe", "path", "winner", "tier", "support", "total", state.alias("state"))


def publish(history: DataFrame, specs: DataFrame) -> DataFrame:
    """history (recipe, version, spec, status) with each row of specs (recipe, spec) appended as the one ACTIVE version.

    Nothing is deleted: what was ACTIVE becomes ARCHIVED.  Of several specs for a recipe the greatest is taken.
    """
    new = specs.groupBy("recipe").agg(F.max("spec").alias("spec"))
    numbered = new.join(next_versions(history, ["recipe"]), "recipe", "left").select("recipe", F.coalesce("next", F.lit(1)).cast(history.schema["version"].dataType).alias("version"), "spec", F.lit("ACTIVE").alias("status"))
    replaced = history.join(new.select("recipe", F.lit(True).alias("__new")), "recipe", "left")
    status = F.when(F.col("__new") & (F.col("status") == "ACTIVE"), "ARCHIVED").otherwise(F.col("status"))
    return replaced.select("recipe", "version", "spec", status.alias("status")).unionByName(numbered)


def rollback(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """history with a copy of each wanted (recipe, version) as the new ACTIVE version; what isn't there changes nothing."""
    return publish(history, wanted.select("recipe", "version").distinct().join(history, ["recipe", "version"]).select("recipe", "spec"))


def review(mappings: DataFrame, decisions: DataFrame) -> DataFrame:
    """mappings (node, concept, status, confidence, active) after decisions (node, concept, action, new_concept, at).

    APPROVE and REJECT set the status of the active mapping; REMAP ends it and adds an APPROVED one of
    confidence 1.  Of several decisions on one mapping the last counts; those on no active mapping do nothing.
    """
    last = decisions.groupBy("node", "concept").agg(F.max_by(F.struct("action", "new_concept"), "at").alias("d"))
    both = mappings.join(last, ["node", "concept"], "left").withColumn("action", F.when(F.col("active"), F.col("d.action")))
    status = F.when(F.col("action") == "APPROVE", "APPROVED").when(F.col("action") == "REJECT", "REJECTED").otherwise(F.col("status"))
    remap = F.coalesce(F.col("action") == "REMAP", F.lit(False))
    kept = F.struct("concept", status.alias("status"), F.col("confidence").cast("double").alias("confidence"), (F.col("active") & ~remap).alias("active"))
    new = F.struct(F.col("d.new_concept").alias("concept"), F.lit("APPROVED").alias("status"), F.lit(1.0).alias("confidence"), F.lit(True).alias("active"))
    return both.select("node", F.explode(F.when(remap, F.array(kept, new)).otherwise(F.array(kept))).alias("m")).select("node", "m.*")


def recrawl(mappings: DataFrame, proposals: DataFrame, mode: str = "fill") -> DataFrame:
    """mappings (node, concept, status) after a new run proposed some, of the same columns.

    fill: only nodes without any mapping get theirs.  reset_auto: mappings that no person has decided
    go first, so that their nodes can get new ones.  APPROVED and REJECTED ones are never touched.
    """
    if mode not in ("fill", "reset_auto"):
        raise ValueError(mode)
    held = mappings if mode == "fill" else mappings.where(F.col("status").isin("APPROVED", "REJECTED"))
    return held.unionByName(proposals.select(*held.columns).join(held.select("node").distinct(), "node", "left_anti"))


def judged_documents(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(run, document, error) of each requested document after its file was read; error null where all is well.

    files: (document, found, error), a row per document: the id that the file's content has now, and what reading it raised.  A document without row has no file; one of another id was moved or renamed, which is an error and makes no new document.
    """
    seen = files.select("document", "found", F.col("error").alias("__e"), F.lit(True).alias("__file"))
    both = requests.select("run", "document").distinct().join(seen, "document", "left")
    error = F.when(F.col("__file").isNull(), "no file").when(F.col("__e").isNotNull(), F.col("__e")).when(~F.col("found").eqNullSafe(F.col("document")), "another document")
    return both.select("run", "document", error.alias("error"))


def recrawl_documents(mappings: DataFrame, proposals: DataFrame, judged: DataFrame, mode: str = "fill") -> DataFrame:
    """mappings (document, node, concept, status) after the proposals of the documents that were read without error.

    A document that failed, or that nobody asked for, keeps its mappings just as they were, whatever else failed: half of a document's changes are never seen.  node names a node across documents.
    """
    done = judged.where("error is null and document is not null").select("document").distinct().withColumn("__done", F.lit(True))
    columns = mappings.columns
    marked = mappings.join(done, "document", "left")
    untouched = marked.where(F.col("__done").isNull()).select(*columns)
    return untouched.unionByName(recrawl(marked.where("__done").select(*columns), proposals.join(done, "document", "left_semi"), mode))


def recrawl_summary(before: DataFrame, after: DataFrame, judged: DataFrame) -> DataFrame:
    """(run, status, documents, errors, reset, mapped) of each run: SUCCESS, PARTIAL or, if every document failed, FAILED; how many mappings went and came."""
    key = ["document", "node", "concept", "status"]
    count = lambda df, other, name: df.select(*key).exceptAll(other.select(*key)).groupBy("document").agg(F.count("*").alias(name))
    each = judged.join(count(before, after, "reset"), "document", "left").join(count(after, before, "mapped"), "document", "left")
    total = each.groupBy("run").agg(F.count("*").alias("documents"), F.count("error").alias("errors"), F.coalesce(F.sum("reset"), F.lit(0)).alias("reset"), F.coalesce(F.sum("mapped"), F.lit(0)).alias("mapped"))
    status = F.when(F.col("errors") == 0, "SUCCESS").when(F.col("errors") < F.col("documents"), "PARTIAL").otherwise("FAILED")
    return total.select("run", status.alias("status"), "documents", "errors", "reset", "mapped")


def release_states(requests: DataFrame, readable: DataFrame, ingested: DataFrame) -> DataFrame:
    """requests (name, status) after a look at the files: REQUESTED becomes RELEASED once the file can be read, either becomes INGESTED once it is in.  Other states stay."""
    seen = lambda df, flag: df.select("name").where("name is not null").distinct().withColumn(flag, F.lit(True))
    both = requests.join(seen(readable, "__read"), "name", "left").join(seen(ingested, "__in"), "name", "left")
    status = F.when(F.col("__in") & F.col("status").isin("REQUESTED", "RELEASED"), "INGESTED").when(F.col("__read") & (F.col("status") == "REQUESTED"), "RELEASED").otherwise(F.col("status"))
    return both.select("name", status.alias("status"))


def group_rollup(sources: DataFrame, overrides: DataFrame, recipes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(root, documents, concepts, sources, n_values) of each group of documents under one root concept.

    sources: (root, document, concept, n) of each approved place.  overrides (root, document, state):
    EXCLUDED documents don't count, INCLUDED ones are members even without a source.  recipes (root):
    groups that have only a recipe are listed with zeros.  tasks: over how many the documents are laid out, if Spark shall not choose.
    """
    places = sources.where("root is not null").select("root", "document", "concept", "n", F.lit(1).alias("s"), F.lit(None).cast("string").alias("state"))
    none = lambda name: F.lit(None).cast(places.schema[name].dataType).alias(name)
    told = overrides.where("state in ('EXCLUDED', 'INCLUDED')").select("root", "document", none("concept"), none("n"), F.lit(0).alias("s"), "state")
    # A document's places and overrides meet once; after that only sums by concept are left.
    both = places.unionByName(told)
    laid = both.repartition(tasks, "root", "document") if tasks else both.repartition("root", "document")
    of_document = Window.partitionBy("root", "document")
    out = F.coalesce(F.max(F.col("state") == "EXCLUDED").over(of_document), F.lit(False)) & F.col("document").isNotNull()
    kept = laid.withColumn("out", out).where("if(s = 1, not out, state = 'INCLUDED')")
    first = F.col("document").isNotNull() & (F.row_number().over(of_document.orderBy("concept")) == 1)
    sums = kept.withColumn("d", first.cast("int")).groupBy("root", "concept").agg(F.sum("d").alias("d"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    empty = recipes.select("root", none("concept"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("s"), F.lit(None).cast(sums.schema["n"].dataType).alias("n"))
    return sums.unionByName(empty).groupBy("root").agg(F.sum("d").alias("documents"), F.count_distinct("concept").alias("concepts"), F.sum("s").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"))


def template_groups(templates: DataFrame, assignments: DataFrame, overrides: DataFrame) -> DataFrame:
    """(template, name, version, documents, override_documents, review_required, failed) of each template version in use.

    assignments: (template, version, document, status).  overrides: (document, status); APPROVED and CONFLICT ones count.
    """
    changed = overrides.where(F.col("status").isin("APPROVED", "CONFLICT")).select("document").distinct().withColumn("__changed", F.lit(1))
    marked = assignments.join(changed, "document", "left")
    counts = marked.groupBy("template", "version").agg(
        F.count("*").alias("documents"), F.count("__changed").alias("override_documents"),
        F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review_required"), F.count_if(F.col("status") == "FAILED").alias("failed"),
    )
    return counts.join(templates.select("template", "name"), "template")


def locate(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, source): the first source of a template, by place, that names the node's range; null where none does.

    A source without sheet fits any sheet; a node without concept takes a source of any concept.
    """
    s = sources.select(F.col("source"), F.col("place"), F.col("range"), F.col("sheet").alias("__sheet"), F.col("concept").alias("__concept"))
    fits = (F.col("__sheet").isNull() | (F.col("__sheet") == F.col("sheet"))) & (F.col("concept").isNull() | (F.col("concept") == F.col("__concept")))
    found = nodes.join(s, "range").where(fits).groupBy("node").agg(F.min_by("source", F.struct("place", "source")).alias("source"))
    return nodes.select("node").distinct().join(found, "node", "left")


def cache_key(source: Column, parser: Column, dictionary: Column, units: Column) -> Column:
    """SHA-256 over the source's hash and the versions of whatever reads it; null where one of them is.  The format is fixed."""
    return F.sha2(F.concat(source.cast("string"), F.lit("|"), parser.cast("string"), F.lit("|"), dictionary.cast("string"), F.lit("|"), units.cast("string")), 256)
