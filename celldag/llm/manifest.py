"""A Merkle manifest of a dataset: one hash tree for each group of rows, one over the groups, and a proof for every row.

Ranks come from digits of the id, as in a radix sort: counts by digits (histograms, each made from the next finer one)
give the number of rows before each bucket, buckets are small by construction, and a window ranks the rows inside
one.  So no sort ever sees all rows.  A rank's digits in the base of the tree's fanout are a leaf's path: nodes with a common prefix
have a common ancestor.  A task reduces all leaves with one prefix (LEVELS levels, at most fanout ** LEVELS leaves), from the longest
prefixes up, and the roots of these small trees are the leaves of the next round.  On the way down the same groups hand out
the siblings' hashes.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celldag.llm.common import cut, shared_folder

FANOUT = 3
LEVELS = 6
DIGIT = 8  # bits; so a parent has 256 children at most, and a bucket 256 different ids
CROWDED = 50_000  # rows; a bucket with more has repeated ids, and is ranked by digits of the leaves' hashes too
BROADCAST = 100_000  # buckets, some 60 bytes each
ID_BYTES = 2  # of the groups' names, for one digit
LOCAL_GROUPS = 10_000  # groups that one window may rank


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` if null, else the length in bytes, a colon and the value; so no two lists of fields look alike when put together."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, group: str, id_col: str, columns: list[str], tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(g, id, leaf, other): the row's group as text that sorts like it (null first, then UTF-8), its id, its hash, and the hash after tampering where that changes a value, else null."""
    hashed = lambda replace: F.unhex(F.sha2(F.concat(*[field(replace.get(c, F.col(f"`{c}`"))) for c in columns]), 256))
    g = F.when(F.col(f"`{group}`").isNull(), "-").otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    other = F.lit(None).cast("binary")
    if tampered:
        changed = F.lit(False)
        for c, new in tampered.items():
            changed = changed | ~F.col(f"`{c}`").eqNullSafe(new)
        other = F.when(changed & (F.lit(True) if when is None else when), hashed(tampered))
    return docs.select(g.alias("g"), F.col(f"`{id_col}`").cast("long").alias("id"), hashed({}).alias("leaf"), other.alias("other"))


# Ranks

def radix_base(buckets: DataFrame, by: list[str], digits: list[str], n: str = "n") -> DataFrame:
    """buckets (by, digits, n), each once, with `base`: the sum of n over what comes before in the same group, by order of the digits.

    Each histogram is the sum of the next finer one; a window sees the children of one parent only.
    """
    if not digits:
        return buckets.withColumn("base", F.lit(0).cast("long"))
    fine = [buckets]
    for i in range(len(digits) - 1, 0, -1):
        fine.append(fine[-1].groupBy(*by, *digits[:i]).agg(F.sum(n).alias(n)))
    base = None
    for i, counts in enumerate(reversed(fine), 1):
        before = Window.partitionBy(*by, *digits[: i - 1]).orderBy(digits[i - 1]).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("base", F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")))
        if base is not None:
            counts = counts.withColumnRenamed("base", "own").join(base, [*by, *digits[: i - 1]]).withColumn("base", F.col("own") + F.col("above")).drop("own", "above")
        base = counts.select(*by, *digits[:i], F.col("base").alias("above"))
    return counts


def _id_digits(rows: DataFrame) -> list[Column]:
    """Digits of the id from the first in which rows differ, without the last one; null ids get the lowest."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    bits = DIGIT if low is None else 64 if (low < 0) != (high < 0) else (low ^ high).bit_length()
    ats = range(DIGIT, max(bits, DIGIT + 1), DIGIT)
    # Shifting keeps the sign, so negative ids come first.  The first digit takes the bits above along, in which no two ids differ.
    digit = [F.coalesce(F.shiftright("id", at).bitwiseAND((1 << DIGIT) - 1), F.lit(-1).cast("long")) for at in reversed(ats)]
    digit[0] = F.coalesce(F.shiftright("id", ats[-1]), F.lit(-(1 << 62)))
    return digit


def ranked(rows: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Rows (g, id, leaf, other) in ascending order of id (null first), leaf and other within their group, as runs of equal rows (rank from 0, n) with their tree's depth; and (g, depth) of the groups.

    A bucket with more than CROWDED rows, which can only be through repeated ids, is taken apart further: equal rows count as one, and the others go by the
    id's last digit and 24 bits of their hash.
    """
    digits = _id_digits(rows)
    names = [f"d{i}" for i in range(len(digits))]
    rows = rows.withColumns(dict(zip(names, digits)))
    counted = cut(rows.groupBy("g", *names).agg(F.count("*").alias("n")))
    sizes = cut(counted.groupBy("g").agg(depth_of(F.sum("n"), fanout).cast("int").alias("depth")))
    # The depth comes with the bucket: a join of rows by group would bring a large group's rows to one task.
    buckets = cut(radix_base(counted, ["g"], names).join(sizes, "g"))
    key = ["g", *names]
    crowded = buckets.where(F.col("n") > CROWDED).select(*key, F.col("base").alias("start"), "depth")
    if crowded.count() <= BROADCAST:
        crowded = F.broadcast(crowded)
    order = ["id", "leaf", "other"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long") - 1
    plain = rows.join(crowded.select(*key), key, "left_anti").withColumn("i", place).join(buckets.select(*key, "base", "depth"), key)
    plain = plain.select("g", "id", "leaf", "other", (F.col("base") + F.col("i")).alias("rank"), F.lit(1).cast("long").alias("n"), "depth")
    copies = rows.join(crowded, key).groupBy(*key, "start", "depth", "id", "leaf", "other").agg(F.count("*").alias("n"))
    low = F.coalesce(F.col("id").bitwiseAND((1 << DIGIT) - 1), F.lit(-1).cast("long"))
    hashed = [F.conv(F.hex(F.col("leaf").substr(2 * i + 1, 2)), 16, 10).cast("int") for i in range(2)]
    copies = cut(copies.withColumns({"e0": low, "e1": hashed[0], "e2": hashed[1]}))
    inner = [*key, "e0", "e1", "e2"]
    bases = radix_base(copies.groupBy(*inner).agg(F.sum("n").alias("n")), key, ["e0", "e1", "e2"]).select(*inner, "base")
    before = Window.partitionBy(*inner).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    split = copies.withColumn("i", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).join(bases, inner)
    split = split.select("g", "id", "leaf", "other", (F.col("start") + F.col("base") + F.col("i")).alias("rank"), "n", "depth")
    return plain.unionByName(split), sizes


def group_ranks(groups: DataFrame) -> DataFrame:
    """(g, rank) of different groups g in order of their bytes, by digits of ID_BYTES bytes each after the bytes that all have in common; as many as leave no bucket of more than LOCAL_GROUPS."""
    low, high = groups.agg(F.min("g"), F.max("g")).first()
    if low is None:
        return groups.select("g", F.lit(0).cast("long").alias("rank"))
    low, high = low.encode(), high.encode()
    common = next((i for i in range(min(len(low), len(high))) if low[i] != high[i]), min(len(low), len(high)))
    names: list[str] = []
    rows = groups.select("g", F.encode("g", "UTF-8").alias("b"))
    while rows.groupBy(*names).count().agg(F.max("count")).first()[0] > LOCAL_GROUPS:
        # An ended name is before longer ones, so it gets the lowest digit.
        names.append(f"d{len(names)}")
        rows = rows.withColumn(names[-1], F.hex(F.col("b").substr(common + 1 + ID_BYTES * (len(names) - 1), ID_BYTES)))
    rows = rows.withColumn("one", F.lit(0))
    key = ["one", *names]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("b")) - 1
    if not names:
        return rows.select("g", place.cast("long").alias("rank"))
    base = radix_base(rows.groupBy(*key).agg(F.count("*").alias("n")), ["one"], names).select(*key, "base")
    return rows.withColumn("i", place).join(base, key).select("g", (F.col("base") + F.col("i")).cast("long").alias("rank"))


# Trees

def depth_of(n: Column, fanout: int) -> Column:
    """Levels of a tree over n leaves: how often n is divided by the fanout, rounding up, until it is 1."""
    powers = [fanout**i for i in range(1, 64) if fanout**i < 1 << 63]
    return sum((F.when(n > p, 1).otherwise(0) for p in powers), F.when(n > 1, 1).otherwise(0))


def _levels_above(hashes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level of a small tree, from its leaves up."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([_digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def _sides(nodes: list[list[str]], i: int, levels: int, fanout: int) -> tuple[list[str], list[str]]:
    """For leaf i of a small tree: at each level what stands before it and after it in its run, put together."""
    left, right = [], []
    for level in range(levels):
        at = i - i % fanout
        left.append("".join(nodes[level][at:i]))
        right.append("".join(nodes[level][i + 1 : at + fanout]))
        i //= fanout
    return left, right


def _up(nodes: DataFrame, done: int, fanout: int, levels: int) -> DataFrame:
    """Nodes (g, rank, n, h, depth) at level `done` to those `levels` higher, or to their tree's root if that comes first."""
    wide = fanout**levels

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        hashes = [h for h, n in zip(pdf["h"], pdf["n"]) for _ in range(n)]
        height = min(levels, max(0, int(pdf["depth"].iloc[0]) - done))
        top = _levels_above(hashes, height, fanout)[-1][0]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "rank": [pdf["rank"].iloc[0] // wide], "n": [1], "h": [top], "depth": [pdf["depth"].iloc[0]]})

    at = F.floor(F.col("rank") / wide)
    return nodes.groupBy("g", at.cast("long")).applyInPandas(reduce, "g string, rank long, n long, h string, depth int")


def _in_blocks(rows: DataFrame, wide: int) -> DataFrame:
    """Runs of equal rows cut at the borders of blocks of `wide` ranks, so that a run's parts go to many tasks."""
    blocks = F.sequence(F.floor(F.col("rank") / wide).cast("long"), F.floor((F.col("rank") + F.col("n") - 1) / wide).cast("long"))
    parts = rows.withColumn("block", F.explode(blocks))
    start = F.greatest(F.col("rank"), F.col("block") * wide)
    end = F.least(F.col("rank") + F.col("n"), (F.col("block") + 1) * wide)
    return parts.withColumn("n", end - start).withColumn("rank", start).drop("block")


def _down(nodes: DataFrame, paths: DataFrame, done: int, fanout: int, levels: int) -> DataFrame:
    """Paths (g, rank, left, right, roots) of the nodes at level `done` from those of the nodes above."""
    wide = fanout**levels

    def spread(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rank")
        hashes, height = list(own["h"]), min(levels, max(0, int(own["depth"].iloc[0]) - done))
        tree, over = _levels_above(hashes, height, fanout), above.iloc[0]
        sides = [_sides(tree, i, height, fanout) for i in range(len(hashes))]
        return pd.DataFrame({"g": own["g"], "rank": own["rank"], "left": [[*a, *over["left"]] for a, _ in sides], "right": [[*b, *over["right"]] for _, b in sides], "roots": [over["roots"]] * len(own)})

    at = F.floor(F.col("rank") / wide).cast("long")
    return nodes.groupBy("g", at).cogroup(paths.groupBy("g", F.col("rank"))).applyInPandas(spread, PATHS)


PATHS = "g string, rank long, left array<string>, right array<string>, roots array<string>"
ROWS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _forest(nodes: DataFrame, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes of every `levels`-th level, from the leaves (not kept here) up to one node for each tree."""
    out = []
    for done in range(0, max(most, 1), levels):
        out.append(cut(_up(out[-1] if out else nodes, done, fanout, levels)))
    return out


def manifest(docs: DataFrame, group: str = "source", id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, when: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A row's leaf is the hash of its columns.  Each group's leaves, in ascending order of the integer id (null first; repeated ids by their hash), are
    hashed in runs of `fanout`, a last shorter run included, level by level until one node is left: the subroot.  The
    subroots, in order of their group (null first, then by UTF-8 bytes), are hashed in the same way to the root.
    proof_sha256 is the hash of the siblings on the way to the root.  folded_root is computed
    from these siblings and the row's hash after tampering: `tampered` gives new values of columns for rows where `when` holds.  verified says
    whether it is the root.  Repeated rows are leaves of their own; an empty table gives no rows; further columns are ignored.
    """
    spark, wide = docs.sparkSession, fanout**levels
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    leaves(docs, group, id_col, list(columns), tampered, when).write.parquet(f"{path}/leaves")
    runs, sizes = ranked(spark.read.parquet(f"{path}/leaves"), fanout)
    _in_blocks(runs, wide).write.parquet(f"{path}/ranked")
    runs = spark.read.parquet(f"{path}/ranked")
    most = sizes.agg(F.max("depth")).first()[0] or 0

    # Up: the groups' trees, then the tree over their subroots.
    first = runs.select("g", "rank", "n", F.lower(F.hex("leaf")).alias("h"), "depth")
    trees = _forest(first, most, fanout, levels)
    tops = cut(trees[-1].select("g", F.col("h").alias("subroot")).join(group_ranks(sizes.select("g")), "g"))
    n_groups = tops.count()
    top_depth = spark.range(1).select(depth_of(F.lit(n_groups), fanout).alias("d")).first()["d"]
    roots = tops.select(F.lit("").alias("g"), "rank", F.lit(1).cast("long").alias("n"), F.col("subroot").alias("h"), F.lit(top_depth).cast("int").alias("depth"))
    over = _forest(roots, top_depth, fanout, levels)

    # Down: from the root to every leaf.
    none = F.array().cast("array<string>")
    paths = over[-1].select("g", "rank", none.alias("left"), none.alias("right"), F.array("h").alias("roots"))
    for i in range(len(over) - 1, -1, -1):
        paths = _down(over[i - 1] if i else roots, paths, i * levels, fanout, levels)
    named = paths.withColumnRenamed("g", "top").join(tops.withColumnRenamed("g", "name"), "rank")
    # A group's subroot goes down with its path.
    paths = cut(named.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("rank"), "left", "right", F.concat(F.array("subroot"), "roots").alias("roots")))
    for i in range(len(trees) - 1, 0, -1):
        paths = _down(trees[i - 1], paths, i * levels, fanout, levels)

    def prove(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own, over = own.sort_values("rank"), above.iloc[0]
        hashes = [h.hex() for h, n in zip(own["leaf"], own["n"]) for _ in range(n)]
        height, (subroot, root) = min(levels, int(own["depth"].iloc[0])), over["roots"]
        tree, out, i = _levels_above(hashes, height, fanout), [], 0
        for doc_id, other, n in zip(own["id"], own["other"], own["n"]):
            for _ in range(n):
                left, right = _sides(tree, i, height, fanout)
                left, right = [*left, *over["left"]], [*right, *over["right"]]
                folded = hashes[i] if other is None else other.hex()
                for a, b in zip(left, right):
                    folded = _digest(a + folded + b)
                proof = _digest("".join(x for side in zip(left, right) for x in side))
                out.append((doc_id, hashes[i], subroot, root, proof, folded, folded == root))
                i += 1
        found = pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        return found.assign(id=pd.array([None if x is None else int(x) for x in found["id"]], "Int64"))

    at = F.floor(F.col("rank") / wide).cast("long")
    # Ids travel as text, as pandas has no long that may be null.
    return runs.withColumn("id", F.col("id").cast("string")).groupBy("g", at).cogroup(paths.groupBy("g", "rank")).applyInPandas(prove, ROWS)


#: The query op13 in DuckDB.  crc32, which DuckDB lacks, is a fold over the digits' bytes, eight shifts after each.
ORACLE = """
WITH RECURSIVE source_rows AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS g, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents
), leaf AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS t, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM source_rows
), tree(g, level, pos, n, h) AS (
  SELECT g, 0, pos, n, h FROM leaf
  UNION ALL
  SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, level, pos // 3, n
), subroots AS (SELECT g, h, level AS depth, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3, n
), root AS (SELECT h AS root FROM top WHERE n = 1
), sides AS (
  SELECT l.g, l.pos AS spot, t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (3 ** t.level)::BIGINT), '') AS a, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (3 ** t.level)::BIGINT), '') AS b
  FROM leaf l JOIN tree t ON t.g = l.g AND t.n > 1 AND t.pos // 3 = l.pos // (3 ** (t.level + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT l.g, l.pos, s.depth + t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (3 ** t.level)::BIGINT), ''), coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (3 ** t.level)::BIGINT), '')
  FROM leaf l JOIN subroots s ON s.g = l.g JOIN top t ON t.n > 1 AND t.pos // 3 = s.pos // (3 ** (t.level + 1))::BIGINT GROUP BY ALL
), proof AS (SELECT g, spot, sha256(string_agg(a || b, '' ORDER BY level)) AS proof, count(*) AS height FROM sides GROUP BY g, spot
), folded(g, spot, level, h) AS (
  SELECT g, pos, 0, t FROM leaf
  UNION ALL
  SELECT f.g, f.spot, f.level + 1, sha256(s.a || f.h || s.b) FROM folded f JOIN sides s ON s.g = f.g AND s.spot = f.spot AND s.level = f.level
)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaf l JOIN subroots s ON s.g = l.g CROSS JOIN root LEFT JOIN proof p ON p.g = l.g AND p.spot = l.pos JOIN folded f ON f.g = l.g AND f.spot = l.pos AND f.level = coalesce(p.height, 0)
"""
