"""A training corpus from documents: quality, near duplicates, repeated passages, decontamination, packing.

Each stage takes the documents that the one before left and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tonefold.llm import containment, jaccard_join, packing, quality_rules, substring_dedup
from tonefold.llm.common import dropped, numbered, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    rows = numbered(docs, "doc_id", "text")
    groups = jaccard_join.similar(rows.select("key", "text"), k=5, percent=80, id_col="key")
    others = written(groups.where("key <> component_id").select("key"), "copies")
    return rows.join(F.broadcast(others) if others.count() <= jaccard_join.SMALL else others, "key", "left_anti").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that stand in an earlier one."""
    out = substring_dedup.dedup(docs, length=20, keep_layout=True, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    rows = numbered(docs, "doc_id", "text")
    leaks = containment.contained(rows.select("key", "text"), table(spark, sf_dir, "benchmark"), id_col="key").select("key").distinct()
    return rows.join(leaks, "key", "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into windows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("packing", packed),
]

#: SQL can't express the packing of the last stage; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i:  # not the table itself
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
