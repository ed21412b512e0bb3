"""Column functions on dynamic cell values, labels, addresses and dates.

A column of mixed values is a struct of `num` (double) and `text` (string), at most one of them
set.  Typed columns stay plain; `num_of`, `text_of` and `is_null` read either kind.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = T.StructType([T.StructField("num", T.DoubleType()), T.StructField("text", T.StringType())])
NUMBER = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


def is_cell(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {f.name for f in kind} == {"num", "text"}


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def num_of(c: Column, kind: T.DataType) -> Column:
    """The number in a cell as a double; null for text."""
    if is_cell(kind):
        return c["num"]
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    return F.lit(None).cast("double")


def fmt_num(x: Column) -> Column:
    """A double as the shortest decimal text with one digit after the point at least: 180.0, 12345678.5, 0.0005.

    From 1e16 up and below 1e-4 it is in scientific notation.
    """
    x = x.cast("double")
    size = F.abs(x)
    plain = x.cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"0+$", ""), r"\.$", ".0")
    small = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0.000"), F.regexp_replace(F.regexp_extract(plain, r"^-?([\d.]+)E-4$", 1), r"\.0$|\.", ""))
    far = F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), r"E(\d+)$", "e+$1")
    tiny = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), r"E-(\d)$", "e-0$1"), r"E-", "e-")
    return F.when(x.isNull() | (size == 0) | ((size >= 1e-3) & (size < 1e7)), plain).when((size >= 1e7) & (size < 1e16), trimmed).when((size >= 1e-4) & (size < 1e-3), small).when(size >= 1e16, far).otherwise(tiny)


def text_of(c: Column, kind: T.DataType) -> Column:
    """A cell as text; null stays null."""
    if is_cell(kind):
        return F.coalesce(c["text"], fmt_num(c["num"]))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return fmt_num(c)
    return c.cast("string")


def is_null(c: Column, kind: T.DataType) -> Column:
    return c.isNull() | (c["num"].isNull() & c["text"].isNull()) if is_cell(kind) else c.isNull()


def to_cell(c: Column, kind: T.DataType) -> Column:
    """Any column as a mixed one."""
    if is_cell(kind):
        return c
    text = F.lit(None).cast("string") if isinstance(kind, T.NumericType) else c.cast("string")
    return F.struct(num_of(c, kind).alias("num"), text.alias("text"))


def parse_number(text: Column) -> Column:
    """The number that the whole text spells, else null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_label(text: Column) -> Column:
    """Compatibility forms composed (full-width letters, unit signs), lower case, without white space and the signs ( ) [ ] { } . - _ / · : #."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[\s()\[\]{}.\-_/·:#]+", "")


def split_label_unit(label: Column, units: list[str]) -> Column:
    """`X(unit)` as struct(label, unit), if the bracket holds a registered unit; else the label unchanged and no unit."""
    inside = F.trim(F.regexp_extract(label, r"^(.*\S)\s*[(\[]([^()\[\]]+)[)\]]\s*$", 2))
    before = F.regexp_extract(label, r"^(.*\S)\s*[(\[]([^()\[\]]+)[)\]]\s*$", 1)
    known = inside.isin(units)
    return F.struct(F.when(known, F.trim(before)).otherwise(label).alias("label"), F.when(known, inside).alias("unit"))


def hue(rgb: Column) -> Column:
    """Coarse hue of an RRGGBB (or AARRGGBB) text: gray, yellow, red, blue or green; null for white, other texts and what is none of these."""
    six = F.right(rgb, F.lit(6))
    r, g, b = (F.conv(F.substring(six, i, 2), 16, 10).cast("int") for i in (1, 3, 5))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    # The limits of each hue, in this order.
    found = (
        F.when(most - least <= 12, F.when(most < 245, "gray")).when((r >= g) & (g >= b) & (r - b > 20) & (r - g < 40), "yellow").when((r > g) & (r > b), "red")
        .when((b > r) & (b >= g), "blue").when((g > r) & (g > b), "green")
    )
    return F.when(six.rlike("^[0-9A-Fa-f]{6}$"), found)


def column_number(letters: Column) -> Column:
    """Spreadsheet column letters to a number from 1: A 1, Z 26, AA 27."""
    codes = F.transform(F.split(F.upper(letters), ""), lambda ch: F.ascii(ch) - 64)
    return F.aggregate(codes, F.lit(0), lambda s, x: s * 26 + x)


def cell_row(address: Column) -> Column:
    """Row number of an A1 address."""
    return F.regexp_extract(address, r"(\d+)$", 1).try_cast("int")


def cell_column(address: Column) -> Column:
    return column_number(F.regexp_extract(address, r"([A-Za-z]+)\$?\d+$", 1))


def formula_references(formula: Column) -> Column:
    """A1 references and ranges in a formula, sheet names kept, $ removed."""
    return F.transform(F.regexp_extract_all(formula, F.lit(r"((?:(?:'[^']+'|[A-Za-z_]\w*)!)?\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?)"), 1), lambda r: F.regexp_replace(r, r"\$", ""))


def parse_date(text: Column) -> Column:
    """Dates spelled YYYY-M-D with -, . or / as a date, else null."""
    return F.try_to_date(F.regexp_replace(F.regexp_extract(text, r"^\s*(\d{4}[-./]\d{1,2}[-./]\d{1,2})", 1), r"[./]", "-"), "yyyy-M-d")


def serial_datetime(serial: Column) -> Column:
    """Spreadsheet serial days (20000 to 65500, from 1899-12-30) as a timestamp without zone."""
    seconds = F.round(serial * 86400).cast("bigint")
    moment = F.timestamp_seconds(seconds - F.lit(2209161600)).cast("timestamp_ntz")
    return F.when((serial >= 20000) & (serial <= 65500), moment)


def time_of_day(text: Column) -> Column:
    """H:MM[:SS] as HH:MM."""
    h, m = (F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})(?::\d{2})?\s*$", i) for i in (1, 2))
    return F.when(text.rlike(r"^\s*\d{1,2}:\d{2}(:\d{2})?\s*$"), F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts as a JSON array, so that neither nulls nor separators in them make two lists of parts equal."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 16)


#: First bytes of known containers, in hex.
MAGICS = {"504B0304": "zip", "D0CF11E0A1B11AE1": "ole"}


def container_kind(content: Column, magics: dict[str, str] | None = None) -> Column:
    """What a file's first 16 bytes say, the longest of the magics first; else unknown."""
    head, out = F.hex(F.substring(content, 1, 16)), F.lit("unknown")
    for magic, kind in sorted((magics or MAGICS).items(), key=lambda m: len(m[0])):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out
