"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

McMahan et al., "Ad Click Prediction: a View from the Trenches" (2013): every coordinate has
its own learning rate from its squared gradients, and L1 keeps a weight at exactly zero until
its gradients add up to more than ``l1``. The weights that remain are few and are broadcast.

Features of a text are the hashed words, pairs of neighbours and pairs with one or two words
between them, each present or absent, so a word counts once however long the text is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from parlance.llm.common import bound_batches, fresh, materialize, pick

HASH_BITS = 20
#: Fixed odd multipliers of the pair hashes: one for each distance between the two words.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
WORD = re.compile(r"\w+")
FOLDS = 5


@dataclass(frozen=True)
class Ftrl:
    """Parameters; ``most_rows`` bounds the sample of labelled documents that the fit reads, and
    ``most_features`` (4 bytes each) all their features: in the sample's random order, documents beyond it are left out.

    Toxic rows are the rarer ones, so their gradients count ``toxic_weight`` times.
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 6
    toxic_weight: float = 3.0
    most_rows: int = 16_000
    most_features: int = 60_000_000


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text, ascending; none for an empty or null text."""
    words = WORD.findall((text or "").lower())
    h = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    parts = [h]
    for gap, mix in enumerate(MIX, start=1):
        if len(h) > gap:
            pair = (h[:-gap] * np.uint64(mix)) ^ (h[gap:] + np.uint64(mix >> gap))
            parts.append(pair * np.uint64(MIX[0]))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - HASH_BITS)).astype(np.int32))


class Learner:
    """FTRL-proximal state: ``z`` and the sum of squared gradients ``n`` of each coordinate; the last is the bias."""

    def __init__(self, how: Ftrl):
        self.how = how
        self.z = np.zeros((1 << HASH_BITS) + 1)
        self.n = np.zeros((1 << HASH_BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.where(np.abs(z) > self.how.l1, z - np.sign(z) * self.how.l1, 0.0)
        return -pull / ((self.how.beta + np.sqrt(n)) / self.how.alpha + self.how.l2)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(at, 1 << HASH_BITS)
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.how.alpha * w
        self.n[at] = n + g * g


def fit_rows(rows: Callable[[], Iterable[tuple[np.ndarray, int]]], how: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights that are not zero; the bias has number ``2 ** HASH_BITS``."""
    learner = Learner(how)
    for _ in range(how.epochs):
        for at, label in rows():
            learner.learn(at, label, how.toxic_weight if label else 1.0)
    w = learner.weights(slice(None))
    kept = np.flatnonzero(w)
    return kept.astype(np.int32), w[kept]


def fold(id_col: str) -> Column:
    """crc32 of the id as text modulo 5; 0 means held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS


def _feature_column():
    @pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype("<i4").tobytes() for t in texts])

    return run


def sample_labels(labels: DataFrame, most_rows: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """At most ``most_rows`` labelled ids outside the held-out fold, those of smallest hash.

    An id that repeats has label 1 if any of its rows has; null ids and null labels are left
    out. The draw is the same in each run.
    """
    known = pick(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null")
    once = known.groupBy("doc_id").agg(F.max((F.col("label") != 0).cast("int")).alias("label"))
    train = once.where(fold("doc_id") != 0)
    return train.withColumn("draw", F.xxhash64("doc_id", F.lit(11))).orderBy("draw", "doc_id").limit(most_rows)


def fit(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights from a bounded sample of labelled documents; text is the only input.

    The sampled ids (at most ``most_rows``) are broadcast, feature numbers are made where the
    documents lie, and one task walks through the sample in hash order. Without labelled
    documents all weights are zero.
    """
    bound_batches(docs.sparkSession)
    drawn = materialize(sample_labels(labels, how.most_rows), "toxic-sample")
    slim = pick(docs, doc_id=id_col, text=text_col)
    rows = slim.join(F.broadcast(drawn), "doc_id").select(
        "draw", "doc_id", "label", F.xxhash64("text").alias("tie"), _feature_column()("text").alias("at")
    )
    # An id that repeats is learnt from once, by its text of the smallest hash.
    rows = rows.groupBy("draw", "doc_id", "label").agg(F.min(F.struct("tie", "at")).alias("one")).select("draw", "doc_id", "label", "one.at")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches stay as they came: their buffers go back to the system as a whole afterwards.
        held, left = [], how.most_features
        for b in batches:
            sizes = np.cumsum([len(at.as_buffer()) // 4 for at in b.column("at")])
            held.append(b.slice(0, int(np.searchsorted(sizes, left, side="right"))))
            left -= int(sizes[-1]) if len(sizes) else 0
            if left <= 0:
                break

        def sample() -> Iterator[tuple[np.ndarray, int]]:
            for b in held:
                for at, label in zip(b.column("at"), b.column("label"), strict=True):
                    yield np.frombuffer(at.as_buffer(), "<i4"), label.as_py()

        number, weight = fit_rows(sample, how)
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(weight)], names=["number", "weight"])

    one = rows.repartition(1).sortWithinPartitions("draw", "doc_id")
    found = one.mapInArrow(train, "number int, weight double").toPandas()
    return found["number"].to_numpy(np.int32), found["weight"].to_numpy(np.float64)


def toxicity(spark: SparkSession, text: Column, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """Score of a text column between 0 and 1; an empty or null text gets the bias alone.

    The weights are broadcast: at most ``2 ** HASH_BITS`` and the bias, 12 bytes each.
    """
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros((1 << HASH_BITS) + 1)
        w[shared.value[0]] = shared.value[1]
        bias = w[1 << HASH_BITS]
        for part in parts:
            z = np.array([w[features(t)].sum() + bias for t in part], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row, the model fitted on the labelled rows of ``docs``.

    Null texts score as empty ones; rows that repeat are scored each. Rows with a null id are
    scored but never trained on. No rows give no rows.
    """
    model = fit(docs, labels, how, id_col, text_col)
    slim = pick(docs, doc_id=id_col, text=text_col)
    scored = slim.select("doc_id", (fold("doc_id") == 0).alias("held_out"), toxicity(docs.sparkSession, F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns, whatever their names.

    Null and empty texts score by the bias alone; rows that repeat score alike. Without usable
    labels all rows score 0.5 by weights of zero: then nothing is known, and all stay. No rows give no rows.
    """
    model = fit(docs, labels, how, id_col, text_col)
    if not len(model[0]):
        return docs
    (score,) = fresh(docs, "score")
    scored = docs.withColumn(score, toxicity(docs.sparkSession, F.col(f"`{text_col}`"), model))
    return scored.where(F.col(score) < 0.5).drop(score)
