"""Fill-in-the-middle: a text's units are arranged anew around sentinels, so that a model learns to write what lies between.

Only functions of Spark SQL: a regular expression takes a text apart into units, digits of a hash of the
document's id say where it is cut and how it is arranged, slices are joined again, and the text is rebuilt by
parsing the sentinels.  A row needs nothing but itself, so there is no exchange and no state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celldag.llm.common import unused

#: One code point; (?s) as line ends are units too.
CODE_POINT = "(?s)."


@dataclass(frozen=True)
class Sentinels:
    """Marks before the three parts.  None may be empty or overlap another or itself, so that they can be found again."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for a in self.all:
            for b in self.all:
                if not a or (a != b and a in b) or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)))) or len(set(self.all)) < 3:
                    raise ValueError(f"sentinels must not overlap: {self.all}")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    @property
    def pattern(self) -> str:
        return "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in self.all)


def hash_words(doc_id: Column, salt: str = "1:", n: int = 4) -> list[Column]:
    """The first n groups of 8 hex digits of the salted id's SHA-256, as numbers.  A null id counts as no digits."""
    hexed = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def arrange(docs: DataFrame, unit: str = CODE_POINT, plain_percent: int = 10, spm_percent: int = 20, salt: str = "1:", marks: Sentinels = Sentinels()) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix, output of every row of docs (doc_id, text).

    unit: a pattern whose matches, one after the other, make up the whole text.  A document cut into n units ends its prefix
    after the smaller of h1 % (n + 1) and h2 % (n + 1) of them and its middle after the larger.  Empty and null texts,
    texts that hold a sentinel, and plain_percent of the rest stay as they are (form `plain`, null parts); of the others, spm_percent have the suffix first
    (`spm`), the rest the prefix (`psm`).  Repeated rows come out once each, alike, as all depends on id and text
    only; other columns are ignored.  A text's units are one array, so a text takes some 60 bytes a unit while it is
    its row's turn.
    """
    new = unused(docs)
    h1, h2, h3, h4 = hash_words(F.col("doc_id"), salt)
    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(unit), F.lit(0)).alias(f"{new}u"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    n = F.size(f"{new}u").cast("long")
    marked = F.col("text").contains(marks.prefix) | F.col("text").contains(marks.suffix) | F.col("text").contains(marks.middle)
    form = F.when((n == 0) | marked | (F.col("h3") % 100 >= 100 - plain_percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.least(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int"), F.greatest(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int")
    placed = cut.select("doc_id", "text", f"{new}u", n.alias("n"), form.alias("form"), a.alias("a"), b.alias("b"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice(f"{new}u", start, length), ""))
    parts = placed.select(
        "doc_id", "text", "n", "form", part(F.lit(1), F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), part(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"),
        *[F.when(F.col("form") != "plain", F.col(c)).cast("long").alias(c) for c in "ab"],
    )
    psm = F.concat(F.lit(marks.prefix), "prefix", F.lit(marks.suffix), "suffix", F.lit(marks.middle), "middle")
    spm = F.concat(F.lit(marks.suffix), "suffix", F.lit(marks.prefix), "prefix", F.lit(marks.middle), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.col("a").alias("prefix_units"), (F.col("b") - F.col("a")).alias("middle_units"), output.alias("output"))


def restore(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that an output of this form was made from.  Neither text nor parts hold a sentinel, so its three places are sure."""
    parts = F.split(output, marks.pattern, 4)  # what is before the first sentinel is empty
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row; an empty table gives no rows."""
    made = arrange(docs, **params)
    marks = params.get("marks", Sentinels())
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form"), marks), 256).alias("restored_sha256"),
    )


#: The query op11 in DuckDB, whose text functions count code points as well.
ORACLE = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hx FROM documents
), cut AS (
  SELECT *, ('0x' || substr(hx, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(hx, 9, 8))::BIGINT % (n + 1) AS c2, ('0x' || substr(hx, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(hx, 25, 8))::BIGINT % 100 AS h4 FROM hashed
), formed AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
