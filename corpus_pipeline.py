"""From raw documents to packed sequences: five stages, each written and read by the next."""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from limitline.llm import exact_dedup, language_id, near_dedup, packing, substring_dedup  # noqa: E402
from limitline.llm.queries import language_model  # noqa: E402
from limitline.llm.storage import stored  # noqa: E402

#: No SQL: models, signatures and tokens; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter go.

    Where no row has a language to learn from, every document with a letter stays.
    """
    model = language_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Columns of the documents may have the names of what is added here.
    inner = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner).withColumnRenamed(inner[docs.columns.index("text")], "text")
    found = language_id.predict(rows, model)
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).drop("lang_pred", "score").toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id.

    A row is known by doc_id and text: one that repeats the id of a dropped copy with
    another text stays. Rows without doc_id, and rows that repeat both, all stay.
    """
    sha = "_" * (1 + max(map(len, docs.columns)))  # in no column's name
    dropped = exact_dedup.exact_groups(docs).where(~F.col("kept")).select("doc_id", F.col("text_sha256").alias(sha))
    own = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return docs.withColumn(sha, own).join(dropped.distinct(), ["doc_id", sha], "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one with the smallest doc_id.

    Rows without doc_id stay; of rows that share one, all go if any is a near copy.
    """
    dropped = near_dedup.near_groups(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(dropped.distinct(), "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has, too."""
    return substring_dedup.without_passages(docs, stored(substring_dedup.repeated_passages(docs), "passages"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), split="words", end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
