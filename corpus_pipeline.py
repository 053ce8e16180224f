"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a
table with the columns of `documents`; the last returns the pieces of packed sequences. `run` writes
each stage's result to the shared folder that `spark.checkpoint.dir` names and reads it again, so a
lost executor costs at most a part of one stage.

All stages take null and empty texts, repeated rows, empty tables and further columns: a null text is
scored and packed as an empty one and has no lines, shingles or leaks; repeated rows are alike to the
classifier, the lines and the decontamination, and copies to near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontam, lines, minhash, packing, quality
from tidemark.llm.common import bounded_batches
from tidemark.llm.queries import table
from tidemark.session import stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents and `labels`, does not reject."""
    bounded_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.scores(model, F.col("text")) >= quality.THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those left without any word go.

    A document loses all lines only if each stands in an earlier document. `n_chars` follows the text.
    """
    bounded_batches(spark)
    cleaned = lines.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    return cleaned.where(~emptied).select(
        *[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bounded_batches(spark)
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    bounded_batches(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096, a row for each piece."""
    bounded_batches(spark)
    return packing.pack_documents(docs.select("doc_id", "text")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

# A trained classifier, signatures and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
