"""One query per operator over its whole table, and SQL for those that it can express.

Operators keep their own outputs (texts, spans, files); the queries derive digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, decontaminate, masks, mtree, pieces, pii, quality_rules, runs, setsketch, shards, substrings, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "component")


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", F.octet_length("kept_text").cast("bigint").alias("n_bytes_kept"))


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "n_secret", "n_spans", F.sha2("clean_text", 256).alias("clean_sha256"))


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


@query("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.interleave(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_clauses")


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = byte_cnn.score(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("bigint").alias("n_items"), "items")


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.word_runs(table(spark, sf_dir, "documents"), reading=runs.planted, texts=False).drop("runs", "n_words")


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op12_ranked_search",
    f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_SPLIT} AS words FROM documents WHERE text IS NOT NULL),
    terms AS (SELECT row, doc_id, len(words) AS n, unnest(words) AS term FROM docs),
    tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM terms GROUP BY ALL),
    corpus AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS total FROM docs WHERE len(words) > 0),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    wanted AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
    items AS (SELECT DISTINCT item_id, text, unnest({_SPLIT}) AS term FROM wanted),
    scored AS (
        SELECT items.item_id, items.text, tf.row, tf.doc_id,
            sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
        FROM items JOIN tf USING (term) JOIN df USING (term) CROSS JOIN corpus GROUP BY ALL),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op11_top_k",
    """
    WITH whole AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS point FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.point, c.point)::BIGINT AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
