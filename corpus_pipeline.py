"""Documents to training tokens: the stages in order, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, pieces, pii, quality_rules, setsketch
from tickloom.session import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified rule rejects go."""
    verdict = quality_rules.verdicts(docs, _table(spark, sf_dir, "labels")).where("kept")
    kept = verdict.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    named = docs.select(*COLUMNS)
    return named.join(kept, named.doc_id.eqNullSafe(F.col("kept_id")) & (key == F.col("kept_key")), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Of rows that share that doc_id the text with the smallest key stays, and a repeated row once. Texts
    without words and rows without doc_id are in no group; of such texts each stays once per doc_id, of such rows all.
    """
    named = docs.select(*COLUMNS)
    verdict = setsketch.near_duplicates(docs).where("kept AND doc_id IS NOT NULL")
    first = verdict.where("n_shingles > 0").groupBy("component", "doc_id").agg(F.min("text_key").alias("text_key")).drop("component")
    kept = first.unionByName(verdict.where("n_shingles = 0").select("doc_id", "text_key").distinct())
    keyed = setsketch.keyed(named.where("doc_id IS NOT NULL")).join(kept, ["doc_id", "text_key"], "left_semi")
    return keyed.dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS).unionByName(named.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.contaminated(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that reveal it; ``n_chars`` follows the text."""
    clean = pii.sanitise(docs, ["lang", "source", "n_chars"])
    length = F.when(F.col("n_chars").isNotNull(), F.length("clean_text").cast(docs.schema["n_chars"].dataType))
    return clean.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", length.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of every text that is left."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("sentencepiece", tokens),
]

# Subword tokens are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
