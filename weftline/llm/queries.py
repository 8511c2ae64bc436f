"""The pN_ queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import budget, chunking, frequent, language, leakage, names, normalize, packing, sentences


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.mislabelled(_t(spark, sf, "test_sentences"))


def p1_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every single-language segment of every text."""
    return language.segments(language.classify_units(_t(spark, sf, "test_sentences")))


def p1_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The main language of every text."""
    rows = language.classify_texts(_t(spark, sf, "test_sentences"), {"sent_id": F.col("sent_id")})
    return rows.select("sent_id", F.col("found").alias("language"), "confidence")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(_t(spark, sf, "test_sentences"))


def _look_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "test_sentences").select(F.lit("test_sentences").alias("tbl"), F.col("sent_id").alias("id"), F.lit(None).cast("bigint").alias("grp"), "text")
    e = _t(spark, sf, "extracted_entity").filter("sent_id is not null").select(F.lit("extracted_entity").alias("tbl"), F.col("entity_id").alias("id"), F.col("sent_id").alias("grp"), "text")
    return s.unionByName(e)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.same_look_pairs(_look_rows(spark, sf))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The records that have a look-alike, one row each with the class they are in."""
    return normalize.same_look_classes(_look_rows(spark, sf))


def p3_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of test_sentences in its consistent form."""
    return normalize.with_form(_t(spark, sf, "test_sentences").select("sent_id", "text"), "text").select("sent_id", "form")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.link_mentions(_t(spark, sf, "extracted_entity"), _t(spark, sf, "known_entity"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent.heavy_hitters(_t(spark, sf, "extracted_entity"), ["label", "text"], 0.004).select("label", "text")


def p5_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same candidates with the bounds of the sketch and without a second count."""
    return frequent.heavy_hitters(_t(spark, sf, "extracted_entity"), ["label", "text"], 0.004, exact=False)


def p6_budget(spark: SparkSession, sf: str) -> DataFrame:
    return budget.token_budget(_t(spark, sf, "test_sentences"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_t(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_passages(_t(spark, sf, "documents"), _t(spark, sf, "eval_item")).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents carry each test item, and the largest part of it that one of them carries."""
    found = leakage.find_passages(_t(spark, sf, "documents"), _t(spark, sf, "eval_item"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max(F.col("n_found") / F.col("n_words")).alias("most"))


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_texts(_t(spark, sf, "documents"))


def queries():
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


P5_FOUND = """
WITH e AS (SELECT label, text FROM extracted_entity WHERE label IS NOT NULL AND text IS NOT NULL)
SELECT label, text FROM e GROUP BY label, text
HAVING count(*) * 1000 >= 4 * (SELECT count(*) FROM e)
"""


def oracle_sql():
    return {"p5_found": P5_FOUND}
