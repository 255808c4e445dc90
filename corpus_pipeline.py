"""Documents to training tokens: language ID, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns of documents.

Nulls, ties and repeats by stage: language ID rejects null texts and texts without letters; line dedup keeps a text of which
every line goes as an empty one; near-dedup keeps empty texts and rows with a null id that are alone in their group, and all
rows that repeat a kept id; mixing takes empty texts no more and reads documents with equal ids one after the other; BPE
gives a null or empty text no tokens. An empty table goes through all stages. Columns that are not those of documents are
dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedelta.llm import bpe, language, line_dedup, mixing, near_dedup
from feedelta.llm.common import cut
from feedelta.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those that no learned language explains."""
    got = language.predict(docs, language.train(docs))
    return got.where((F.col("lang_pred") != language.UND) & ~F.col("foreign")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines; n_chars follows the text."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, in training order."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), ids_sha256, decoded_sha256."""
    got = bpe.round_trip(docs.select("doc_id", "text"), vocabulary_path())
    return got.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("mixing", mixed),
    ("BPE", tokens),
]

#: SQL expresses neither cross-parsing nor BPE; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, "stage")
    return docs
