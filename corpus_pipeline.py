"""A training corpus from `documents`: five of the operators in turn, each on all that the one before kept.

Quality classifier (documents that it rejects go), near-duplicates (one document of each group stays),
benchmark decontamination (documents that hold a benchmark item go), secret scan (secrets are masked in
the text), and packing into sequences. Each stage takes (spark, docs, sf_dir); all but the last return
the columns of docs, whatever their names.

Defined results: a null or empty text is graded like any other, is a near-duplicate of nothing, holds no
benchmark item or secret, and is packed as its end mark alone; a null id is no near-duplicate of anything;
repeated rows share their fate in every stage but packing, which packs each; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars import session
from tidebars.llm import decontaminate, minhash, ordinal, packing, secrets
from tidebars.llm.common import materialize

#: The last stage needs a tokenizer, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ordinal.train(docs, _table(spark, sf_dir, "labels"), ordinal.ratings())
    return ordinal.select(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, 80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, 2048)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written as Parquet and read again as the next one's docs."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
