"""The registered queries of this subpackage: opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celldag.llm import bpe, chat, decontaminate, fill_middle, html_extract, jaccard_join, langid, licenses, manifest, quality, topk, toxicity, url_filter
from celldag.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item, with the item and how much of it the document covers; null and empty texts hold none, repeated rows come out once each."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("tiles").alias("n_tiles"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's token ids and the text they decode to, as hashes; a null text counts as empty."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back from the output; a null text counts as empty."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat.digests(chat.format_chat(turns.unionByName(own).withColumn("parts", chat.text_parts())))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's score and class, learned from the labels of four folds out of five; a null text counts as empty."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector, by exact inner products; vectors that are null or hold null or non-finite numbers take no part."""
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; a null page counts as empty."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of texts that share four fifths of their 5-word shingles; null and empty texts link with nothing."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), percent=80, k=5)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's language, learned from two folds out of three; `und` where no letter is."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license notices, by MinHash bands and exact containment; null and empty texts hold none."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; a null url has empty ones."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document cut at places that its id's hash says, arranged around sentinels, and rebuilt from the output."""
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's score and class, learned from the labels of four folds out of five."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof; where the id's crc32 is even, the proof is tried on a text without its line ends."""
    found = manifest.manifest(table(spark, sf_dir, "documents"), tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, when=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_bpe, op3_chat_format, op4_toxicity, op5_exact_topk, op6_html_text, op7_jaccard_join, op8_language_id, op9_license_scan, op10_url_filter, op11_fill_middle, op12_quality, op13_merkle_manifest)}

#: Only where SQL can express the whole result.
ORACLES: dict[str, str] = {"op5_exact_topk": topk.ORACLE, "op9_license_scan": licenses.ORACLE, "op11_fill_middle": fill_middle.ORACLE, "op13_merkle_manifest": manifest.ORACLE}
