"""Approximate nearest neighbours by learned partitions.

After Dong et al., "Learning Space Partitions for Nearest Neighbor Search" (2020): the
neighbour graph of a bounded sample is cut into balanced parts, a small classifier learns a
vector's part, every vector is filed under its most probable part, and a query looks into the
several parts that the classifier gives it. What it finds there is ranked exactly.

How many parts a query looks into is measured: the fewest for which held-back sample queries
find the wanted share of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import bound_batches, materialize, pick


@dataclass(frozen=True)
class Partitions:
    """``most_sample`` bounds the fit; ``part_rows`` is a part's intended size, ``block_rows`` (a
    shelf of parts) and ``block_queries`` what one task compares at once."""

    most_sample: int = 8192
    part_rows: int = 2000
    most_parts: int = 256
    links: int = 10
    slack: float = 1.1
    recall: float = 0.97
    block_rows: int = 16384
    block_queries: int = 4096
    epochs: int = 30


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def neighbour_graph(x: np.ndarray, links: int) -> np.ndarray:
    """Nearest neighbours by inner product inside the sample, in blocks."""
    out = np.empty((len(x), min(links, len(x) - 1)), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = _top(s, out.shape[1])
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float, rng: np.random.Generator) -> np.ndarray:
    """Part of each sample vector: seeds far apart, then moves to the part of most graph neighbours with room."""
    n = len(x)
    room = int(np.ceil(n / parts * slack))
    seeds = [int(rng.integers(n))]
    near = x @ x[seeds[0]]
    while len(seeds) < parts:
        seeds.append(int(np.argmin(np.where(np.isin(np.arange(n), seeds), np.inf, near))))
        near = np.maximum(near, x @ x[seeds[-1]])
    centres = x[seeds]
    both = np.concatenate([graph, np.full((n, 1), -1)], axis=1)
    part = np.full(n, -1)
    for _ in range(8):
        pull = x @ centres.T
        best = np.sort(pull, axis=1)
        size = np.zeros(parts, np.int64)
        part = np.full(n, -1)
        for i in np.argsort(best[:, -2] - best[:, -1] if parts > 1 else best[:, -1], kind="stable"):
            for p in np.argsort(-pull[i], kind="stable"):
                if size[p] < room:
                    part[i] = p
                    size[p] += 1
                    break
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else centres[p] for p in range(parts)])
    size = np.bincount(part, minlength=parts)
    for _ in range(6):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i, :-1]], minlength=parts)
            p = int(np.argmax(np.where(size < room, votes, -1)))
            if votes[p] > votes[part[i]]:
                size[part[i]] -= 1
                size[p] += 1
                part[i] = p
                moved += 1
        if not moved:
            break
    return part


def train_classifier(x: np.ndarray, soft: np.ndarray, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression on soft labels by Adam; returns weights and bias."""
    w, b = np.zeros((x.shape[1], soft.shape[1])), np.zeros(soft.shape[1])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a : a + 256]
            z = x[rows] @ w + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - soft[rows]) / len(rows)
            step += 1
            for value, grad, m, v in ((w, x[rows].T @ d, *state[:2]), (b, d.sum(axis=0), *state[2:])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, b


@dataclass(frozen=True)
class Router:
    w: np.ndarray
    b: np.ndarray
    probes: int
    scale: float

    def parts(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k most probable parts of each vector, best first."""
        z = (x * self.scale) @ self.w + self.b
        return np.argsort(-z, axis=1, kind="stable")[:, :k]


def learn(sample: np.ndarray, rows: int, how: Partitions, top: int) -> Router:
    """Cut the sample's graph, train the classifier and measure how many parts queries need."""
    rng = np.random.default_rng(0)
    n = len(sample)
    parts = int(max(1, min(how.most_parts, rows // how.part_rows, n // 16)))
    scale = 1 / max(1e-12, float(np.sqrt((sample**2).sum(axis=1).mean())))
    if parts == 1:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), 1, scale)
    graph = neighbour_graph(sample, how.links)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    part = balanced_parts(unit, graph, parts, how.slack, rng)
    soft = np.zeros((n, parts))
    np.add.at(soft, (np.repeat(np.arange(n), graph.shape[1]), part[graph].reshape(-1)), 1.0 / (graph.shape[1] + 1))
    np.add.at(soft, (np.arange(n), part), 1.0 / (graph.shape[1] + 1))
    held = rng.random(n) < 0.1
    w, b = train_classifier(sample[~held] * scale, soft[~held], how.epochs, rng)
    router = Router(w, b, parts, scale)
    filed = router.parts(sample, 1)[:, 0]
    asks = np.flatnonzero(held)[:512]
    s = sample[asks] @ sample.T
    s[np.arange(len(asks)), asks] = -np.inf
    want = filed[_top(s, min(top, n - 1))]
    order = np.argsort(router.parts(sample[asks], parts), axis=1)
    needed = np.take_along_axis(order, want, axis=1) + 1
    share = [(needed <= m).mean() for m in range(1, parts + 1)]
    probes = next((m for m, r in enumerate(share, start=1) if r >= how.recall), parts)
    return Router(w, b, probes, scale)


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _compare(top: int):
    """One shelf: the best of its vectors for each of its queries, scored as an exact sum in a fixed order.

    A query meets only the vectors of the parts that it looks into.
    """

    def run(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(asks) and len(rows):
            rows = rows.sort_values("vec_id", kind="mergesort")
            ids = rows["vec_id"].to_numpy()
            x = np.stack(rows["v"].to_numpy()).astype(np.float64)
            q = np.stack(asks["v"].to_numpy()).astype(np.float64)
            names = asks["query_id"].to_numpy()
            kinds, part = np.unique(rows["part"].to_numpy(), return_inverse=True)
            looks = np.stack([np.isin(kinds, p) for p in asks["parts"]])
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ x.T
                s[~looks[a : a + 256][:, part]] = -np.inf
                k = min(top, len(ids))
                edge = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                margin = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
                for i in range(len(s)):
                    near = np.flatnonzero((s[i] >= edge[i] - margin[i]) & np.isfinite(s[i]))
                    exact = (x[near] * q[a + i]).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out["query_id"] += [names[a + i]] * len(best)
                    out["vec_id"] += ids[near][best].tolist()
                    out["score"] += exact[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def shelves(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """``part, first shelf, shelves``: small parts share a shelf of ``most`` rows, a large part gets several."""
    out, shelf, room = [], 0, most
    for part, n in sorted(sizes.items()):
        need = max(1, -(-n // most))
        if need > 1 or n > room:
            shelf, room = shelf + (room < most), most
        out.append((part, shelf, need))
        if need > 1:
            shelf, room = shelf + need, most
        else:
            room -= n
    return out


def search(
    vectors: DataFrame, every: int = 20, top: int = 20, how: Partitions = Partitions(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score, n_parts, n_probed``: for ids divisible by ``every`` their ``top`` nearest by inner product.

    ``n_parts`` is the number of learned parts, ``n_probed`` how many of them each query looked into.

    Null ids, and vectors that are null, zero or hold null or non-finite components take no
    part, nor do vectors of another length than most (ties: the shortest). A query never finds
    rows with its own id. Equal scores rank by id. Vectors that are equal are compared once:
    of each only the ``top + 1`` smallest ids can be among the results. Rows that repeat count
    once. If no vector is usable, there are no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    clean = pick(vectors, vec_id=id_col, v=vector_col).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    clean = clean.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).withColumn("same", F.xxhash64("v"))
    lengths = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_parts int, n_probed int")
    clean = clean.where(F.size("v") == lengths["d"])
    # Ids of equal vectors; a hash shared by different vectors only means that they are not merged (v is in the key).
    # Each task keeps the smallest ids of a vector before the exchange, so a hot vector's ids never gather.
    smallest = Window.partitionBy("same", "v").orderBy("vec_id")
    once = clean.select("same", "v", "vec_id").distinct().withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= top + 1)
    few = once.groupBy("same", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    kinds = materialize(few.select("same", "v", "ids", F.element_at("ids", 1).alias("vec_id")), "vectors")
    rows = kinds.count()
    drawn = kinds.orderBy(F.xxhash64("same", F.lit(5)), "vec_id").limit(how.most_sample).select("v").toPandas()
    router = learn(np.stack(drawn["v"].to_numpy()).astype(np.float64), rows, how, top)
    shared = spark.sparkContext.broadcast(router)

    def file(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = shared.value
            for b in batches:
                if len(b):
                    parts = r.parts(_matrix(b.column("v")), k).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts.tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "parts"])

        return run

    filed = kinds.select("vec_id", "ids", "v").mapInArrow(file(1), "vec_id long, ids array<long>, v array<double>, parts array<int>")
    filed = materialize(filed.select("vec_id", "ids", "v", F.element_at("parts", 1).alias("part")), "filed-vectors")
    sizes = {r["part"]: r["n"] for r in filed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    asks = clean.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    asks = materialize(asks.mapInArrow(file(router.probes), "query_id long, v array<double>, parts array<int>"), "routed-queries")
    plan = spark.createDataFrame(shelves(sizes, how.block_rows), "part int, first int, shelves int")  # at most most_parts rows
    looks = asks.select("query_id", F.explode("parts").alias("part")).join(F.broadcast(plan), "part")
    looks = looks.select("query_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shelves") - 1)).alias("shelf")).distinct()
    # A shelf is copied once for each block of the queries that look into it, not of all queries.
    slices = F.ceil(F.count("*") / how.block_queries).cast("int")
    looks = materialize(looks, "query-shelves")
    cuts = materialize(looks.groupBy("shelf").agg(slices.alias("slices")), "shelf-slices")
    left = looks.join(cuts, "shelf").join(asks, "query_id")
    left = left.select("query_id", "v", "parts", "shelf", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int").alias("slice"))
    own = F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("shelves")).cast("int")
    right = filed.join(F.broadcast(plan), "part").select("vec_id", "v", "part", own.alias("shelf")).join(cuts, "shelf")
    right = right.select("vec_id", "v", "part", "shelf", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    key = ["shelf", "slice"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_compare(top + 1), "query_id long, vec_id long, score double")
    # A query's own vector may have other ids, so the representative stays in until ids are spread out.
    spread = near.join(filed.select("vec_id", "ids"), "vec_id").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return spread.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score", F.lit(len(router.b)).alias("n_parts"), F.lit(router.probes).alias("n_probed")
    )
