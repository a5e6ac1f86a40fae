"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.

Defined results: empty tables give no rows. A null text fails the quality rules, so nothing after them meets one. Documents with a null doc_id
are judged by the base rules alone, keep their lines, are no near-duplicate of any and are not held against the benchmark; they
are encoded like the others. Rows of one doc_id go together in every stage but line dedup, where rows of other texts are documents of
their own. Of equal or tied documents the smallest doc_id stays. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.llm import byte_bpe, decontaminate, line_dedup, quality_rules, simhash
from lakeglass.llm.common import durable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject go."""
    return quality_rules.quality_filter(docs, table(spark, sf_dir, "labels"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or nearly, go; n_chars counts what is left."""
    return line_dedup.line_dedup(docs, counts=False).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.near_dedup(docs).select(docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    import public_tokenizers

    coded = byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality), ("line dedup", unique_lines), ("SimHash near-dedup", unique_documents), ("benchmark decontamination", clean_of_benchmark), ("byte-level BPE", encode)]

#: SQL cannot express the near-duplicate, decontamination and encoding stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
