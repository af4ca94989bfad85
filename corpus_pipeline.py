"""A training corpus from documents: quality rules, near-duplicates, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents. For every stage: an empty table
gives an empty one; null ids, sources and languages are values of their own; further columns are dropped, whatever their names;
texts are read whole, however long (each is held whole in a task).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, jaccard, mixing, pii, quality
from tidewater.llm.queries import VOCABULARY
from tidewater.llm.storage import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go: a null or empty text among them, repeated rows all alike."""
    return quality.ledger(docs.select(*COLUMNS)).where(~quality.rejected(quality.STANDARD)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles are alike by 0.8 or more stays: the least by id (null ids last), then
    by the hash of its text, then by its other columns."""
    key = (F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    judged = materialise(jaccard.near_duplicates(docs.select(*COLUMNS)), "pipeline-judged")
    least = judged.groupBy("component").agg(F.min(F.struct(*key, "text_hash")).alias("least")).select("least.*")
    rows = docs.select(*COLUMNS).withColumn("text_hash", jaccard.text_hash())
    single = rows.groupBy(*key, "text_hash").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return single.join(least, ["nameless", "id", "text_hash"]).select("doc_id", "text", "rest.lang", "rest.source", "rest.n_chars")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span gives way to its kind; n_chars follows. A null text stays null, with n_chars 0."""
    clean = pii.detect(docs.select(*COLUMNS), redacted=True)
    return clean.select("doc_id", F.col("pii_text").alias("text"), "lang", "source", F.coalesce(F.length("pii_text"), F.lit(0)).cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without a word is taken never."""
    mixed = mixing.mix(mixing.with_size(docs.select(*COLUMNS), keep_text=True))
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that the mix holds; a null text has none."""
    coded = bpe.encode_texts(docs.select("doc_id", "source", "text"), VOCABULARY, public_tokenizers.PATTERN, ids=True)
    return coded.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_duplicates), ("pii", personal_data), ("mixing", source_mix), ("byte_bpe", tokens)]

#: SQL can't express the transducers, the rounding or the tokenizer; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
