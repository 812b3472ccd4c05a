"""Histogram sort: exact byte counts below probed key boundaries, then one exchange.

After Kale and Krishnan's histogram sort and its sampled successors: the driver keeps an
interval of keys for every splitter, all partitions count rows and bytes below the probes
inside the intervals, and the probes are refined until every splitter is within tolerance.
Only the (bounded) probe histogram reaches the driver; the rows move once, at the end.

The key is 64 bits: 40 of the text's hash and 24 of the row's id, so that equal texts lie
together, a large group of copies can still be cut, and the order is the same in each run.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import bound_batches, materialize, pick

GROUP_BITS = 24
KEY_LOW, KEY_HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Cut:
    """``key`` starts a part; ``below_bytes`` and ``below_rows`` lie before it."""

    key: int
    below_bytes: int
    below_rows: int


def _counts(rows: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows with a key below each probe."""
    at = np.array(sorted(set(probes)), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, count = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        for b in batches:
            slot = np.searchsorted(at, b.column("key").to_numpy(), side="right")
            np.add.at(size, slot, b.column("size").to_numpy())
            np.add.at(count, slot, 1)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"slot": full, "size": size[full], "n": count[full]})

    sums = rows.select("key", "size").mapInArrow(run, "slot long, size long, n long")
    size, count = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
    for r in sums.groupBy("slot").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():
        size[r["slot"]], count[r["slot"]] = r["size"], r["n"]
    return dict(zip(at.tolist(), zip(np.cumsum(size)[:-1].tolist(), np.cumsum(count)[:-1].tolist(), strict=True), strict=True))


def find_cuts(rows: DataFrame, parts: int, tolerance: float = 0.002, probes: int = 24, first: Sequence[int] = ()) -> list[Cut]:
    """``parts - 1`` splitters of ``rows(key long, size long)`` with near-equal bytes between them.

    A splitter is settled once the bytes below it are within ``tolerance`` of a part of its
    target, or when one row or no key is left between its bounds (one key holds what is missing); then
    the nearer bound counts. ``probes`` a splitter and round go out, so that the driver
    holds ``parts * probes`` counts. Among settled probes one that keeps a group of equal
    texts whole is preferred. ``first``: keys of a sample, which all splitters probe before.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.count("*").alias("n")).first()
    goal = [total["s"] * k / parts for k in range(1, parts)]
    slack = tolerance * total["s"] / parts
    low = [Cut(KEY_LOW, 0, 0)] * len(goal)
    high = [Cut(KEY_HIGH, total["s"], total["n"])] * len(goal)
    done: list[Cut | None] = [None] * len(goal)
    if first and goal:
        cuts = [low[0], *(Cut(p, *c) for p, c in _counts(rows, list(first)).items()), high[0]]
        below = [c.below_bytes for c in cuts]
        for k, g in enumerate(goal):
            at = min(max(bisect_right(below, g), 1), len(cuts) - 1)
            low[k], high[k] = cuts[at - 1], cuts[at]
            near = min(low[k], high[k], key=lambda c: (abs(c.below_bytes - g), c.key))
            if abs(near.below_bytes - g) <= slack:
                done[k] = near
    while any(c is None for c in done):
        wanted: dict[int, list[int]] = {}
        for k, g in enumerate(goal):
            if done[k] is not None:
                continue
            a, b = low[k].key, high[k].key
            if b - a <= 1 or low[k].below_bytes == high[k].below_bytes or high[k].below_rows - low[k].below_rows <= 1:
                done[k] = min(low[k], high[k], key=lambda c: (abs(c.below_bytes - g), c.key))
                continue
            n = min(probes, b - a - 1)
            inner = {a + (b - a) * j // (n + 1) for j in range(1, n + 1)}
            inner |= {a + int((b - a) * (g - low[k].below_bytes) / (high[k].below_bytes - low[k].below_bytes))}
            inner |= {p >> GROUP_BITS << GROUP_BITS for p in inner}
            wanted[k] = [p for p in inner if a < p < b]
        if not wanted:
            continue
        seen = _counts(rows, [p for v in wanted.values() for p in v])
        for k, mine in wanted.items():
            cuts = [Cut(p, *seen[p]) for p in sorted(mine)]
            fits = [c for c in cuts if abs(c.below_bytes - goal[k]) <= slack]
            if fits:
                done[k] = min(fits, key=lambda c: (c.key % (1 << GROUP_BITS) != 0, abs(c.below_bytes - goal[k]), c.key))
                continue
            low[k] = max([low[k], *(c for c in cuts if c.below_bytes <= goal[k])], key=lambda c: c.key)
            high[k] = min([high[k], *(c for c in cuts if c.below_bytes > goal[k])], key=lambda c: c.key)
    out = sorted((c for c in done if c is not None), key=lambda c: (c.key, c.below_bytes))
    return out


def sort_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, key`` of each row; no text is kept."""
    slim = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    group = F.shiftleft(F.shiftright(F.xxhash64(text), GROUP_BITS), GROUP_BITS)
    own = F.xxhash64(F.col("doc_id"), F.lit(7)).bitwiseAND(F.lit((1 << GROUP_BITS) - 1))
    return slim.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), group.bitwiseOR(own).alias("key")
    )


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.002,
    rows_per_part: int = 50_000,
    most_parts: int = 4096,
) -> DataFrame:
    """Deal all rows to ``shards`` shards of near-equal bytes.

    Returns ``doc_id, size, text_crc32, key, shard int, slot long``; ``slot`` counts from 0
    without a gap inside each shard, in key order. A shard consists of equal parts, each
    ranked by a task of its own, so no task holds a shard. A null text has size 1 and the
    checksum of the empty text; rows equal in id and text share a key and stay together.
    No rows give no rows.
    """
    bound_batches(docs.sparkSession, 10_000)
    rows = materialize(sort_keys(docs, id_col, text_col), "shard-keys")
    n = rows.count()
    per = max(4, min(most_parts // shards, -(-n // (rows_per_part * shards))))
    cuts = find_cuts(rows, shards * per, tolerance)
    keys, before = [c.key for c in cuts], [0, *(c.below_rows for c in cuts)]
    starts = np.array(keys, dtype=np.int64)
    first_row = [before[s * per] for s in range(shards)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.searchsorted(starts, b.column("key").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=[*b.schema.names, "part"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"doc_id {id_type}, size long, text_crc32 long, key long, part int")
    offsets = docs.sparkSession.createDataFrame(
        [(p, p // per, before[p] - first_row[p // per]) for p in range(shards * per)], "part int, shard int, skip long"
    )
    rank = Window.partitionBy("part").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = dealt.withColumn("place", F.row_number().over(rank))
    return ranked.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", "key", "shard", (F.col("skip") + F.col("place") - 1).alias("slot")
    )
