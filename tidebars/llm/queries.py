"""The operators with production parameters on their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars import session
from tidebars.llm import decontaminate, lines, minhash, negatives, ordinal, packing, passages, pii, pii_sql, quality, quantize, secrets, sharding, sql, warc, wrapper


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return session.ship(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"), 85)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeats(_read(spark, sf_dir, "documents", "doc_id", "text")).drop("__key")


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(_read(spark, sf_dir, "documents", "doc_id", "text")).drop("__key")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.col("quality") >= 1) & (F.col("toxic") < 1)
    return quality.apply(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), good)


def op7_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents", "doc_id", "text"), 2048)


def op9_ordinal_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = ordinal.train(docs, _read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), ordinal.ratings())
    return ordinal.grade(docs, model).drop("text")


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.plan(_read(spark, sf_dir, "documents", "doc_id", "text"), 16)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.compress(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontaminate": op3_decontaminate,
    "op4_html_extraction": op4_html_extraction,
    "op5_passage_dedup": op5_passage_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc_reassembly": op7_warc_reassembly,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_ordinal_classifier": op9_ordinal_classifier,
    "op10_rendezvous_sharding": op10_rendezvous_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_personal_data": op12_personal_data,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_secret_scan": sql.SECRET_SCAN,
    "op4_html_extraction": sql.HTML_EXTRACTION,
    "op5_line_dedup": sql.LINE_DEDUP,
    "op7_warc_reassembly": sql.WARC_REASSEMBLY,
    "op11_vector_codes": sql.VECTOR_CODES,
    "op12_personal_data": pii_sql.PERSONAL_DATA,
    "op13_hard_negatives": sql.HARD_NEGATIVES,
}
