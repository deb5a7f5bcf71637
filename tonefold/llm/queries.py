"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, containment, jaccard_join, language_id, licence_scan, packing, quality_rules, revisits, simhash, spelling, sql, substring_dedup, token_counts, toxicity
from .common import table

TOKEN_LIMIT = 4096


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_token_counts(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), budgets=(TOKEN_LIMIT,))
    digest = F.xxhash64("prefix_counts").alias("prefix_digest")  # of the counts at all prefixes
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.col(f"fit_{TOKEN_LIMIT}").alias("chars_within_limit"), digest)


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


def op5_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_not_modified_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "url_key", "response_id", "status", headers.alias("headers"))


def op8_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op11_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar(table(spark, sf_dir, "documents"), k=3, most=3)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_rotated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dimensions=64, scale=256, salt="2")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_prefix_token_counts,
        op2_divergence_rules,
        op3_ngram_jaccard_join,
        op4_licence_sentences,
        op5_fm_substring_dedup,
        op6_minhash_containment,
        op7_not_modified_revisits,
        op8_toxicity_trees,
        op9_min_slack_packing,
        op10_string_kernel_language,
        op11_pigeonring_simhash,
        op12_spelling_variants,
        op13_rotated_centroids,
    )
}

#: DuckDB SQL for the same rows, where SQL can express them.
SQL: dict[str, str] = {
    "op2_divergence_rules": sql.quality(),
    "op3_ngram_jaccard_join": sql.jaccard(4, 85),
    "op4_licence_sentences": sql.licences(),
    "op5_fm_substring_dedup": sql.substrings(20),
    "op6_minhash_containment": sql.containment(containment.SHINGLE, 80),
    "op7_not_modified_revisits": sql.not_modified(),
    "op13_rotated_centroids": sql.centroids(),
}
