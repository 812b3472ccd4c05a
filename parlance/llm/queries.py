"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import fingerprints, licenses, mixing, neighbours, packing, sharding, simhash, suffix, tokens, toxicity

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), 1024)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), 20, 20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op8_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.cube_mix(_table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), how=simhash.Sketch(shingle=4, bits=64, radius=4))
    return found.select("doc_id", simhash.as_hex(F.col("f0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scans": op1_license_scans,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_histogram_shards": op3_histogram_shards,
        "op4_token_counts": op4_token_counts,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_toxicity": op6_toxicity,
        "op7_retrieval_packing": op7_retrieval_packing,
        "op8_cube_mixing": op8_cube_mixing,
        "op9_weighted_fingerprints": op9_weighted_fingerprints,
        "op10_simhash_components": op10_simhash_components,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": licenses.oracle_sql()}
