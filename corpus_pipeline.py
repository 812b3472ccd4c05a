"""From raw documents to packed training sequences, one operator a stage.

Every stage reads what the stage before kept and returns the columns of ``documents``; the
last returns packed pieces. ``run`` writes each stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import mixing, packing, simhash, suffix, toxicity
from parlance.llm.common import materialize
from parlance.llm.queries import tokenizer_path

#: A repeated run of 50 words, or of 400 bytes in whatever script, is a passage; runs are searched from 160 bytes on.
PASSAGE = suffix.Passages(words=50, long=400, length=160)
#: Shingles of five words, a Jaccard similarity of 0.8 as SimHash measures it.
NEAR = simhash.similar(0.8, shingle=5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, rejects go.

    Null and empty texts score by the model's bias alone; rows that repeat score alike; without
    usable labels all stay. No rows give no rows.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five words one stays: the one with the smallest id.

    Null ids come last, ties go to the smaller text hash, and of rows equal in both one stays. Null
    and empty texts and texts without words are copies of each other. No rows give no rows.
    """
    return simhash.keep_one(docs, how=NEAR)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut wherever they stand; documents left blank go.

    Null and empty texts stay, and so does a document whose text was blank before. No rows give no rows.
    """
    cut = suffix.cut_repeats(docs, suffix.Repeats(length=PASSAGE.length), PASSAGE)
    return cut.withColumn("n_chars", F.char_length("text").cast(cut.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the balanced mix takes it.

    Null and empty texts have no words and are drawn like others; a null source is a source of
    its own; rows that repeat share what is taken of them. No rows give no rows.
    """
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids.

    A null text counts as empty and is packed as its closing id; rows that repeat are packed
    each; very long texts are cut at window ends. No rows give no rows.
    """
    return packing.pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but the mix's sizes can be told in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages together make of ``documents``."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = materialize(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
