"""Queries of concept mapping: parts' names as concepts, and what people make of such names as labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldag.functions.units import Units
from celldag.operators import concepts
from celldag.queries.dag import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def part_fields(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fields, concepts, names and units: a field per part, labelled by its name as it is, shouted, misspelled, cut, below a header that says more, or turned around."""
    part, units = read(spark, sf_dir, "part"), Units.parse()
    label = F.expr("""case p_partkey % 6 when 0 then p_name when 1 then concat(upper(p_name), ' [1]') when 2 then concat(substr(p_name, 1, 1), substr(p_name, 3))
        when 3 then split(p_name, ' ')[0] when 4 then 'PV' else concat(split(p_name, ' ')[1], ' ', split(p_name, ' ')[0]) end""")
    value = F.expr("case when p_partkey % 5 = 0 then named_struct('num', cast(null as double), 'text', concat(p_size, if(p_size % 2 = 0, ' kg', ' mm'))) else named_struct('num', cast(p_size as double), 'text', cast(null as string)) end")
    fields = part.withColumn("label", label).select(
        F.col("p_partkey").alias("field"), F.col("p_brand").alias("document"), F.col("p_type").alias("sheet"), "label", F.when(F.col("p_partkey") % 6 == 4, F.array("p_name", "label")).otherwise(F.array("label")).alias("path"),
        F.expr("if(p_partkey % 5 = 0, null, element_at(array('kg', 'mm', null), cast(p_size % 3 as int) + 1))").alias("unit"), value.alias("value"), F.lit(False).alias("is_formula"), F.expr("if(p_size % 4 = 0, 'input', 'unknown')").alias("style_role"),
    )
    name = part.select("p_name").distinct()
    # As many rows as there are different names: a vocabulary.
    vocabulary = name.select(
        F.col("p_name").alias("concept"), F.expr("row_number() over (order by p_name)").alias("ord"), F.col("p_name").alias("name"), F.expr("case when p_name like 'b%' then 'mass' when p_name like 's%' then 'length' end").alias("dimension"),
        F.expr("if(p_name like '%ring', array('LARGE', 'Brand#2'), array())").cast("array<string>").alias("keywords"), F.expr("if(p_name like '%bolt', array('result'), array())").cast("array<string>").alias("roles"),
    )
    known = name.select(F.col("p_name").alias("concept"), F.col("p_name").alias("name"))
    table = spark.createDataFrame([(s, d) for s in units.spellings() for d in units.dimensions_of(s)], "unit string, dimension string")
    return fields, vocabulary, known, table


@register()
def map_concepts(spark, sf_dir):
    """Every part's field mapped to a concept, or left open (checked against a plain version in tests, as SQL has no Ratcliff-Obershelp ratio)."""
    return concepts.decide(*part_fields(spark, sf_dir))


@register()
def similar_names(spark, sf_dir):
    """All pairs of different labels and names of parts with a ratio of 0.55 or more (checked against all pairs in tests)."""
    fields, _, known, _ = part_fields(spark, sf_dir)
    return concepts.similar(fields.select(F.lower("label").alias("a")), known.select(F.col("name").alias("b")))


@register("""
WITH d AS (SELECT p_brand, p_partkey, p_name, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' (kg)' ELSE 'unknown ' || p_partkey END AS meaning FROM part),
t AS (SELECT p_brand, p_partkey, p_name, 't' || p_partkey AS term FROM d WHERE k < 3 UNION ALL SELECT p_brand, p_partkey, p_name, regexp_replace(lower(meaning), '[ ()_-]', '', 'g') FROM d WHERE k < 3)
SELECT p_brand AS document, term, arg_min(p_name, p_partkey) AS concept FROM t GROUP BY ALL
""")
def dictionary_terms(spark, sf_dir):
    """Terms of a dictionary sheet per brand, with the parts' names as concepts; every fourth entry explains nothing."""
    part = read(spark, sf_dir, "part")
    meaning = F.expr("case p_partkey % 4 when 0 then p_name when 1 then upper(p_name) when 2 then concat(p_name, ' (kg)') else concat('unknown ', p_partkey) end")
    row = F.col("p_partkey") + 1
    body = part.select(F.col("p_brand").alias("document"), F.lit("dictionary").alias("sheet"), row.alias("row"), F.explode(F.create_map(F.lit(1), F.concat(F.lit("T"), F.col("p_partkey").cast("string")), F.lit(2), meaning, F.lit(3), F.lit("kg"))).alias("col", "text"))
    heads = part.select(F.col("p_brand").alias("document")).distinct().select("document", F.lit("dictionary").alias("sheet"), F.lit(0).cast("long").alias("row"), F.explode(F.create_map(F.lit(1), F.lit("Tag"), F.lit(2), F.lit("Meaning"), F.lit(3), F.lit("Unit"))).alias("col", "text"))
    known = part.select(F.col("p_name").alias("concept"), F.col("p_name").alias("name")).distinct()
    # The vocabulary is in the names' order, so the name tells a concept's place.
    return concepts.dictionary_terms(concepts.dictionary_entries(body.unionByName(heads)), known, known.select("concept", F.col("name").alias("ord")))
