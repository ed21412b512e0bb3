"""Queries of the region rules over sheets made of parts: one sheet per part, of three shapes by its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celldag.operators import regions
from celldag.queries.dag import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
UNITS = ["℃", "mm", "kg", "%"]


def register(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _cell(row: int, col: int, value: Column | str | float, when: Column | None = None, fill: str | None = None, bold: bool = False, last_col: int | None = None) -> Column:
    """A cell as a struct; null where the condition doesn't hold.  Texts are columns of strings or plain strings."""
    value = F.lit(value) if not isinstance(value, Column) else value
    number = F.typeof(value) != "string"
    cell = F.struct(
        F.lit(row).alias("row"), F.lit(col).alias("col"), F.when(~number, value.cast("string")).alias("text"), F.when(number, value.try_cast("double")).alias("num"),
        F.lit(fill).cast("string").alias("fill"), F.lit(bold).alias("bold"), F.lit(last_col).cast("int").alias("last_col"),
    )
    return cell if when is None else F.when(when, cell)


def _sheets(spark, sf_dir, *cells: Column) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name")
    return part.select(F.col("p_partkey").cast("string").alias("sheet"), F.explode(F.array_compact(F.array(*cells))).alias("x")).select("sheet", "x.*")


def _sized(k: int) -> Column:
    return (F.col("p_size") * k).cast("double")


@register("""
SELECT CAST(p_partkey AS VARCHAR) AS sheet, r.n AS "row", l.label, l.unit, CASE WHEN p_partkey % 2 = 0 THEN CAST(c.k * 10 AS VARCHAR) ELSE chr(65 + CAST(c.k AS INT)) END AS row_key, (p_size * c.k * r.m)::DOUBLE AS num
FROM part, (VALUES (3, 1), (4, 2)) r(n, m), (VALUES (1, 'core T', '℃'), (2, 'rise', 'mm')) l(m, label, unit), (VALUES (1), (2), (3)) c(k) WHERE l.m = r.m AND p_partkey % 3 <> 0
""")
def region_trailing_labels(spark, sf_dir):
    """Rows whose label and unit stand at their end; even sheets have a row that names the columns, every third sheet one such row only (so none counts)."""
    even, two = F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 != 0
    keys = [_cell(1, 1, "time", even), *[_cell(1, k + 1, F.lit(k * 10.0), even) for k in (1, 2, 3)]]
    rows = [_cell(3, k + 1, _sized(k)) for k in (1, 2, 3)] + [_cell(3, 5, "core T"), _cell(3, 6, "℃")]
    more = [_cell(4, k + 1, _sized(2 * k), two) for k in (1, 2, 3)] + [_cell(4, 5, "rise", two), _cell(4, 6, "mm", two)]
    found = regions.trailing_labels(_sheets(spark, sf_dir, *keys, *rows, *more), UNITS)
    return found.select("sheet", "row", "label", "unit", "row_key", "num")


@register("""
SELECT CAST(p_partkey AS VARCHAR) AS sheet, 'CORE TEMP' AS label, '℃' AS unit, v.v || '@' || CASE p_partkey % 3 WHEN 0 THEN CAST(c.k AS VARCHAR) ELSE chr(65 + CAST(c.k AS INT)) END AS row_key, (p_size * c.k * v.m)::DOUBLE AS num
FROM part, (VALUES ('plain', 1), ('RUM', 2)) v(v, m), (VALUES (1), (2), (3)) c(k) WHERE p_partkey % 3 <> 2
UNION ALL SELECT CAST(p_partkey AS VARCHAR), v.v, v.u, chr(65 + CAST(c.k AS INT)), (p_size * c.k * v.m)::DOUBLE FROM part, (VALUES ('core max(℃)', '℃', 1), ('crack%', '%', 2)) v(v, u, m), (VALUES (1), (2), (3)) c(k) WHERE p_partkey % 3 = 2
""")
def region_caption_groups(spark, sf_dir):
    """A caption over rows of variants, with or without a row that names the columns; or rows that carry label and unit themselves."""
    captioned, keyed = F.col("p_partkey") % 3 != 2, F.col("p_partkey") % 3 == 0
    top = [_cell(1, 1, "Time", keyed), *[_cell(1, k + 1, F.lit(float(k)), keyed) for k in (1, 2, 3)], _cell(3, 1, "CORE TEMP (℃)", captioned)]
    name = lambda a, b: F.when(captioned, a).otherwise(b)
    rows = [_cell(4, 1, name("plain", "core max(℃)")), *[_cell(4, k + 1, _sized(k)) for k in (1, 2, 3)], _cell(5, 1, name("RUM", "crack%")), *[_cell(5, k + 1, _sized(2 * k)) for k in (1, 2, 3)]]
    return regions.caption_groups(_sheets(spark, sf_dir, *top, *rows), UNITS).select("sheet", "label", "unit", "row_key", "num")


@register("SELECT CAST(p_partkey AS VARCHAR) AS sheet, r AS \"row\" FROM part, (VALUES (2), (3)) t(r) WHERE p_partkey % 3 <> 0")
def region_forced_headers(spark, sf_dir):
    """A row of units below a row of names; every third sheet has too few units."""
    few = F.col("p_partkey") % 3 == 0
    cells = [_cell(2, c, t) for c, t in ((1, "name"), (2, "core"), (3, "length"), (4, "note"))] + [_cell(3, 1, "text"), _cell(3, 2, F.when(few, "hot").otherwise("℃")), _cell(3, 3, F.when(few, "long").otherwise("110~190")), _cell(3, 4, F.col("p_brand"))]
    cells += [_cell(4, 1, F.col("p_name")), *[_cell(4, c, _sized(c)) for c in (2, 3, 4)]]
    return regions.forced_headers(_sheets(spark, sf_dir, *cells), UNITS)


@register("SELECT CAST(p_partkey AS VARCHAR) AS sheet, r AS \"row\", 'Block ' || p_brand AS text FROM part, (VALUES (2), (9), (16)) t(r) WHERE p_partkey % 4 <> 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), r, 'Part ' || p_brand FROM part, (VALUES (4), (11)) t(r) WHERE p_partkey % 4 = 0")
def region_repeated_headers(spark, sf_dir):
    """Bold, filled titles over four columns that repeat; titles inside them repeat too, and count where the outer ones stand alone."""
    outer = F.col("p_partkey") % 4 != 0
    title, part = F.concat(F.lit("Block "), F.col("p_brand")), F.concat(F.lit("Part "), F.col("p_brand"))
    cells = [_cell(r, 1, title, outer if r > 2 else None, "DDEBF7", True, 4) for r in (2, 9, 16)] + [_cell(r, 1, part, None, "FFF2CC", False, 3) for r in (4, 11)] + [_cell(6, 1, "wide and plain", None, None, False, 5), _cell(7, 1, "wide and plain", None, None, False, 5), _cell(8, 1, _sized(1))]
    return regions.repeated_headers(_sheets(spark, sf_dir, *cells)).select("sheet", "row", "text")


@register("""
SELECT CAST(p_partkey AS VARCHAR) AS sheet, 'weight' AS label, 'kg' AS unit, p_size::DOUBLE AS num, NULL AS text FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'lone', NULL, NULL, 'brand' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'brand', NULL, NULL, p_brand FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'wide', NULL, (p_size * 2)::DOUBLE, NULL FROM part
""")
def region_adjacent_pairs(spark, sf_dir):
    """Pairs in a row; in even sheets a lone text shifts the pairing, a far value has no label, a merged label reaches its value."""
    even = F.col("p_partkey") % 2 == 0
    one = [_cell(1, 1, "weight (kg)"), _cell(1, 2, _sized(1)), _cell(1, 4, "lone", even), _cell(1, 5, "brand"), _cell(1, 6, F.col("p_brand")), _cell(1, 10, _sized(9))]
    cells = _sheets(spark, sf_dir, *one, _cell(2, 1, "far"), _cell(2, 4, _sized(7)), _cell(3, 1, "wide", None, None, False, 4), _cell(3, 6, _sized(2)))
    return regions.adjacent_pairs(cells, cells.select("sheet", "row").distinct(), UNITS).drop("row")


@register("""
SELECT CAST(p_partkey AS VARCHAR) AS sheet, l.label, CASE WHEN h.h <> '판정' THEN l.unit END AS unit, h.h AS row_key, CASE WHEN h.h = '판정' THEN 'result' END AS role, CASE WHEN h.h <> '판정' THEN (p_size * h.k * l.m)::DOUBLE END AS num, CASE WHEN h.h = '판정' THEN p_brand END AS text
FROM part, (VALUES ('vibration', 'mm', 1), ('pressure', 'kg', 2)) l(label, unit, m), (VALUES ('min', 1), ('max', 2), ('판정', 3)) h(h, k)
""")
def region_row_concepts(spark, sf_dir):
    """Rows are concepts with a unit in a column or in the label; columns are limits and a verdict."""
    head = {1: "item", 2: "unit", 3: "min", 4: "max", 5: "판정"}
    rows = [_cell(2, 1, "vibration"), _cell(2, 2, "mm"), _cell(3, 1, "pressure (kg)")]
    rows += [_cell(r, 2 + k, _sized(k * (r - 1))) for r in (2, 3) for k in (1, 2)] + [_cell(r, 5, F.col("p_brand")) for r in (2, 3)]
    cells = _sheets(spark, sf_dir, *rows)
    leaves = cells.select("sheet").distinct().select("sheet", F.explode(F.create_map(*[F.lit(x) for kv in head.items() for x in kv])).alias("col", "leaf"))
    found = regions.row_concepts(cells, cells.select("sheet", "row").distinct(), leaves, F.lit(1), UNITS, F.lit(2))
    return found.select("sheet", "label", "unit", "row_key", "role", "num", "text")


@register("SELECT CAST(p_partkey AS VARCHAR) AS sheet, 'overall' AS label, '%' AS unit, (p_size * 3)::DOUBLE AS num, NULL AS text, NULL AS note FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'overall', '%', NULL, p_brand, NULL FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, NULL, NULL, 'see ' || p_type || ' below' FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, NULL, NULL, 'end' FROM part")
def region_summaries_and_notes(spark, sf_dir):
    """A summary row's label with its values; runs of note rows as one text each."""
    cells = _sheets(spark, sf_dir, _cell(1, 1, "overall (%)"), _cell(1, 2, _sized(3)), _cell(1, 3, F.col("p_brand")), _cell(3, 1, "see "), _cell(3, 2, F.col("p_type")), _cell(4, 1, "below"), _cell(7, 1, "end"), _cell(4, 5, _sized(1)))
    rows = cells.select("sheet", "row").distinct()
    one = regions.summaries(cells, rows.where("row = 1"), UNITS).select("sheet", "label", "unit", "num", "text", F.lit(None).cast("string").alias("note"))
    two = regions.notes(cells, rows.where("row > 1")).select("sheet", *[F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("unit", "string"), ("num", "double"), ("text", "string"))], "note")
    return one.unionByName(two)


@register("SELECT CAST(p_partkey AS VARCHAR) AS sheet, f AS fill, m AS meaning FROM part, (VALUES ('DDEBF7', 'PLC'), ('FFF2CC', 'typed')) t(f, m) WHERE p_partkey % 2 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'C00000', 'alarm ' || p_brand FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), '00B050', 'normal' FROM part WHERE p_partkey % 2 = 1")
def region_legends(spark, sf_dir):
    """Inline legends on even sheets (odd ones have one pair only), a table of swatches on all."""
    even = F.col("p_partkey") % 2 == 0
    inline = [_cell(1, 1, F.when(even, "파랑=PLC / 노란색 = typed").otherwise("파랑=PLC")), _cell(2, 1, _sized(1), None, "DDEBF7"), _cell(2, 2, _sized(2), None, "FFF2CC")]
    table = [_cell(1, 8, "Legend"), _cell(2, 8, "", None, "C00000"), _cell(2, 9, F.concat(F.lit("# alarm "), F.col("p_brand"))), _cell(3, 8, "normal", ~even, "00B050"), _cell(3, 9, "beside"), _cell(5, 8, "", None, "FFFFFF"), _cell(5, 9, "behind a gap")]
    cells = _sheets(spark, sf_dir, *inline, *table)
    one = regions.inline_legend(cells)
    return one.unionByName(regions.table_legend(cells, ["legend", "범례"], "alarm|normal").select("sheet", "fill", "meaning"))
