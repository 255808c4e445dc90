"""The registered queries of this subpackage with their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedelta.llm import bpe, chat, fingerprint, language, line_dedup, mixing, near_dedup, permutation_index, sharding, warc

VOCABULARY = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, vocabulary_path()))


@register()
def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@register(sharding.SQL)
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=16, keep=["doc_id"])


@register()
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


@register(warc.SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register(near_dedup.SQL)
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


@register(line_dedup.SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@register()
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


@register(chat.SQL)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations have no tool calls of their own: calls and results are added to all of them by rule."""
    return chat.format_chats(chat.with_tools(_table(spark, sf_dir, "conversations")), chat.tool_schemas(spark, chat.REGISTRY))


@register(mixing.SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by training position; a document that the mix reads more than once stands at its first reading."""
    got = mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")
    return got.orderBy(F.col("position").asc_nulls_last(), "doc_id")
