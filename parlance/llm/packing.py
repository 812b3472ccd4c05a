"""Lexical retrieval packing with a sharded BM25 inverted index.

Documents are dealt to shards of near-equal size by content: a tree of centroids, fitted on a
sample of BM25 weights that are projected to a few dimensions, gives each document a path, and
paths in order are cut into shards, so neighbours meet in a shard at any number of shards. A
shard's task builds an inverted index over its documents; the document frequencies behind the
weights are exact counts over all documents, by token id, so they fit in an array of the
vocabulary's size. From a seed document, BM25 ranks the unused documents of the shard, and the
best fill the seed's window one after the other. A document that does not fit is cut: its rest
seeds the next window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from parlance.llm.common import discard, materialize, pick
from parlance.llm.sharding import GROUP_BITS, find_cuts
from parlance.llm.tokens import WholeEncoder, share, worker_encoder

WINDOW = 1024
SHARD_TOKENS = 1_000_000
END_ID = 0
DIMS = 128
BRANCH, DEPTH, LEAF_ROWS = 8, 5, 64
SAMPLE_ROWS = 16_384


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


def counted_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, order, kind, ids, n, seen``: each document's ids with the closing id 0, as 16-bit integers in a binary column.

    ``kind`` names the text. ``seen`` is null; the last row of each task has nothing else: in how many of its
    documents each id occurs, so that the ids need not be read again to count them.
    """
    shared = share(docs.sparkSession, path)
    if max(shared.value.whole.values(), default=0) >= 1 << 16:
        raise ValueError("ids must fit in 16 bits")
    text = F.coalesce("text", F.lit(""))
    slim = pick(docs, doc_id=id_col, text=text_col).withColumns({"order": F.xxhash64("doc_id", text, F.lit(5)), "kind": F.xxhash64(text, F.lit(3))})
    end = np.array([END_ID], "<u2").tobytes()
    names = ["doc_id", "order", "kind", "ids", "n", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, "<u2", WholeEncoder)
        seen, last = np.zeros(1 << 16, np.int64), None
        for b in batches:
            ids = [encoder.ids(t).tobytes() + end for t in b.column("text").to_pylist()]
            for x in ids:
                t = np.sort(np.frombuffer(x, "<u2"))
                seen[t[np.append(True, t[1:] != t[:-1])]] += 1
            n = pa.array([len(x) // 2 for x in ids], pa.int64())
            last = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("order"), b.column("kind"), pa.array(ids, pa.binary()), n, pa.nulls(len(ids), pa.binary())], names=names)
            yield last
        if last is not None:
            at = np.flatnonzero(seen)
            packed = at.astype("<u2").tobytes() + seen[at].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in last.schema if f.name != "seen"), pa.array([packed], pa.binary())], names=names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.select("doc_id", "order", "kind", "text").mapInArrow(run, f"doc_id {kind}, order long, kind long, ids binary, n long, seen binary")


def token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, order, ids, n`` of ``counted_tokens``."""
    return counted_tokens(docs, path, id_col, text_col).where("seen IS NULL").select("doc_id", "order", "ids", "n")


def document_frequency(counted: DataFrame) -> np.ndarray:
    """In how many documents each id occurs, counted over all of them; the array has the vocabulary's size.

    Rows that repeat count each; an empty text has its closing id alone. No rows give zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column("seen").to_pylist():
                size = len(x) // 6
                seen[np.frombuffer(x, "<u2", size)] += np.frombuffer(x, "<u4", size, 2 * size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["token", "n"])

    parts = counted.where("seen IS NOT NULL").select("seen")
    sums = parts.mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << 16, np.int64)
    out[sums["token"].to_numpy()] = sums["n"].to_numpy()
    return out


def idf(df: np.ndarray, total: int) -> np.ndarray:
    return np.log1p((total - df + 0.5) / (df + 0.5))


class Index:
    """Inverted index of one shard: for each token the documents that hold it and their BM25 weights.

    Every token is indexed and queries. A token of over an eighth of the shard's documents has
    its weights in a dense row, which is at most eight times the size of its postings. Documents
    that are used up can be taken out; ``here`` numbers those that are left.
    """

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, total: int, mean: float, how: Bm25):
        self.n = len(docs)
        self.here = np.arange(self.n)
        self.terms: list[np.ndarray] = []
        freq = []
        for ids in docs:
            t, c = np.unique(ids, return_counts=True)
            self.terms.append(t.astype(np.int64))
            freq.append(c)
        sizes = np.array([len(t) for t in self.terms])
        doc = np.repeat(np.arange(self.n), sizes)
        term = np.concatenate(self.terms) if self.n else np.empty(0, np.int64)
        tf = np.concatenate(freq).astype(np.float64) if self.n else np.empty(0)
        length = np.array([len(d) for d in docs], np.float64)
        norm = how.k1 * (1 - how.b + how.b * length / max(mean, 1.0))
        weight = (idf(df, total)[term] * tf * (how.k1 + 1) / (tf + norm[doc])).astype(np.float32)
        often = np.flatnonzero(np.bincount(term, minlength=1 << 16) * 8 > self.n)
        self.row = np.full(1 << 16, -1, np.int64)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), np.float32)
        thick = self.row[term] >= 0
        self.dense[self.row[term[thick]], doc[thick]] = weight[thick]
        doc, term, weight = doc[~thick], term[~thick], weight[~thick]
        by = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by], weight[by]
        self.start = np.searchsorted(term[by], np.arange((1 << 16) + 1))

    def keep(self, left: np.ndarray) -> None:
        """Only the documents of ``here`` that ``left`` marks stay."""
        self.here, self.dense = self.here[left], self.dense[:, left]
        number = np.cumsum(left) - 1
        stay = left[self.doc]
        self.start = np.concatenate(([0], np.cumsum(stay)))[self.start]
        self.doc, self.weight = number[self.doc[stay]], self.weight[stay]
        self.n = len(self.here)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of the documents that are left for the distinct tokens of the seed."""
        t = self.terms[seed]
        a, b = self.start[t], self.start[t + 1]
        size = b - a
        total = int(size.sum())
        at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total) if total else np.empty(0, np.int64)
        rows = self.row[t]
        asked = np.zeros(len(self.dense), np.float32)
        asked[rows[rows >= 0]] = 1
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n) + asked @ self.dense


_SIGNS: list[np.ndarray] = []


def _signs() -> np.ndarray:
    if not _SIGNS:
        _SIGNS.append(np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (1 << 16, DIMS)))
    return _SIGNS[0]


def vector(ids: np.ndarray, rarity: np.ndarray, mean: float, how: Bm25) -> np.ndarray:
    """BM25 weights of a document's tokens, projected to ``DIMS`` random signs and of length 1."""
    t, c = np.unique(ids, return_counts=True)
    w = rarity[t] * c * (how.k1 + 1) / (c + how.k1 * (1 - how.b + how.b * len(ids) / max(mean, 1.0)))
    x = w.astype(np.float32) @ _signs()[t]
    return x / max(float(np.sqrt(x @ x)), 1e-9)


@dataclass
class Node:
    centres: np.ndarray
    along: np.ndarray
    below: list[Node | None]


def grow(x: np.ndarray, depth: int = DEPTH) -> Node | None:
    """Tree of centroids by k-means on unit vectors; siblings stand along their main axis."""
    if depth == 0 or len(x) < LEAF_ROWS:
        return None
    rng = np.random.default_rng(len(x))
    c = x[rng.choice(len(x), BRANCH, replace=False)]
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(BRANCH)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    axis = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0]
    c = c[np.argsort(c @ axis, kind="stable")]
    own = (x @ c.T).argmax(axis=1)
    return Node(c, axis, [grow(x[own == k], depth - 1) if (own == k).sum() < len(x) else None for k in range(BRANCH)])


def place(x: np.ndarray, tree: Node | None) -> np.ndarray:
    """For each row of ``x`` the path in the tree, then 20 bits of the place along the last node's axis."""
    path, along = np.zeros(len(x), np.int64), np.zeros(len(x))
    waiting = [(np.arange(len(x)), tree, 0)] if tree is not None and len(x) else []
    while waiting:
        rows, node, depth = waiting.pop()
        k = (x[rows] @ node.centres.T).argmax(axis=1)
        path[rows] += k * BRANCH ** (DEPTH - 1 - depth)
        along[rows] = x[rows] @ node.along
        for b, below in enumerate(node.below):
            inner = rows[k == b]
            if below is not None and len(inner):
                waiting.append((inner, below, depth + 1))
    return (path << 20) + np.clip(((along + 1) * (1 << 19)).astype(np.int64), 0, (1 << 20) - 1)


def content_keys(table: DataFrame, rarity: np.ndarray, mean: float, how: Bm25) -> tuple[DataFrame, list[int]]:
    """``table`` with ``key``: the place of its content, then bits of its hash, so that copies lie together and can be cut.

    Also the keys at which the sampled documents' places begin.
    """
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(rarity)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [vector(np.frombuffer(ids, "<u2"), shared.value, mean, how).tobytes() for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], names=["x"])

    # Equal texts count once; the smallest hashes are a random sample that is the same in each run.
    last = table.select("kind").distinct().orderBy("kind").limit(SAMPLE_ROWS).agg(F.max("kind")).first()[0]
    some = table.where(F.col("kind") <= F.lit(last)).dropDuplicates(["kind"]).orderBy("kind")
    rows = [np.frombuffer(r["x"], np.float32) for r in some.select("ids").mapInArrow(sample, "x binary").collect()]
    grown = grow(np.stack(rows)) if rows else None
    tree = spark.sparkContext.broadcast(grown)
    marks = np.unique(place(np.stack(rows), grown)) << GROUP_BITS if rows else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = place(np.stack([vector(np.frombuffer(ids, "<u2"), shared.value, mean, how) for ids in b.column("ids").to_pylist()]), tree.value)
            own = b.column("order").to_numpy() & ((1 << GROUP_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((at << GROUP_BITS) | own)], names=[*b.schema.names, "key"])

    kind = table.schema["doc_id"].dataType.simpleString()
    keyed = table.select("doc_id", "order", "ids", "n").mapInArrow(run, f"doc_id {kind}, order long, ids binary, n long, key long")
    return keyed, marks.tolist()


def fill(docs: list[np.ndarray], index: Index, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Greedy filling: ``(document, start, length, sequence, offset)`` of each piece."""
    unused = np.ones(len(docs), dtype=bool)  # of the documents that the index still has
    at, seq, used, done = 0, 0, 0, 0
    now: int | None = None
    rank: np.ndarray | None = None
    while True:
        if now is None or at == len(docs[now]):
            if done == len(docs):
                return
            best = int(np.argmax(rank)) if rank is not None and len(rank) else 0
            if rank is None or rank[best] <= 0:
                best = int(np.argmax(unused))  # the first in order
            now, at, done = int(index.here[best]), 0, done + 1
            unused[best] = False
            if rank is not None:
                rank[best] = 0
        if used == 0:  # the first of a window is its seed
            if 4 * int(unused.sum()) < 3 * len(unused):
                index.keep(unused)
                unused = np.ones(index.n, dtype=bool)
            rank = index.scores(now)
            rank[~unused] = 0
        n = min(window - used, len(docs[now]) - at)
        yield now, at, n, seq, used
        at, used = at + n, used + n
        if used == window:
            seq, used = seq + 1, 0


def pack(
    docs: DataFrame,
    path: str,
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    how: Bm25 = Bm25(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of sequences of at most ``window`` tokens that hold every token of every document once.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids``,
    the piece's token ids. Only the last window of a shard is short. A null text counts as
    empty and is packed as its closing id alone; rows that repeat are packed each. No rows
    give no rows. Ties in score go to the document with the smaller hash.
    """
    spark = docs.sparkSession
    counted = materialize(counted_tokens(docs, path, id_col, text_col), "pack-tokens")
    table = counted.where("seen IS NULL").drop("seen")
    sums = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    total, mean = int(sums["n"]), sums["tokens"] / max(1, sums["n"])
    shards = max(1, -(-int(sums["tokens"]) // shard_tokens))
    df = document_frequency(counted).astype(np.float64)
    shared = spark.sparkContext.broadcast(df)
    starts = np.empty(0, np.int64)
    if shards > 1:
        keyed, marks = content_keys(table, idf(df, total), mean, how)
        table = materialize(keyed, "pack-placed")
        discard(counted)
        starts = np.array([c.key for c in find_cuts(table.select("key", F.col("n").alias("size")), shards, 0.05, first=marks)], np.int64)
    else:
        table = table.withColumn("key", F.col("order"))

    @pandas_udf("long")
    def deal(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, keys.to_numpy(), side="right").astype(np.int64))

    def run(rows: pa.Table) -> pa.Table:
        # Ids stay in Arrow: a pandas column of long with a null would round them.
        rows = rows.sort_by([("order", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        parts = [np.frombuffer(x.as_buffer(), "<u2") for x in rows.column("ids")]
        found = np.array(list(fill(parts, Index(parts, shared.value, total, mean, how), window)), np.int64).reshape(-1, 5)
        own, start, length, seq, offset = found.T
        cut = [parts[r][s : s + n] for r, s, n in zip(own.tolist(), start.tolist(), length.tolist(), strict=True)]
        return pa.table(
            {
                "doc_id": rows.column("doc_id").take(pa.array(own)),
                "start": start,
                "length": length,
                "ids_crc32": pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cut], pa.int64()),
                "doc_tokens": rows.column("n").take(pa.array(own)),
                "sequence_id": (rows.column("shard")[0].as_py() << 32) + seq,
                "offset": offset,
                "ids": pa.array([c.tobytes() for c in cut], pa.binary()),
            }
        )

    kind = table.schema["doc_id"].dataType.simpleString()
    dealt = table.select("doc_id", "order", "ids", "n", deal("key").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
