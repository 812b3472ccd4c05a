"""Balanced mixing of sources by the cube method.

After Deville and Tillé ("Efficient balanced sampling: the cube method", 2004): the vector
of inclusion probabilities walks inside the unit cube along the null space of the balancing
constraints, here the number of documents and the number of words, until no walk is left;
only a small landing problem remains. A source with target r times its size takes each
document floor(r) times, and once more with probability r - floor(r).

The walk runs in blocks of bounded size and hands what is still fractional (at most as many
documents a block as there are constraints) to the next level, until one block is left.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import bound_batches, fresh, materialize, pick

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3.0
BLOCK_ROWS = 4096
#: Documents of a block that wait for the largest ones.
RESERVE = 256
EPS = 1e-9
#: Targets are made at the driver and broadcast; more sources than this raise an error.
MOST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null counts 0."""
    words = F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")).cast("long")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), words).otherwise(F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[float], most: float = MOST_TIMES) -> list[float]:
    """Words for each source: by weight, at most ``most`` times its size, the excess dealt again by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in over]
        left = max(left, 0.0)
    return out


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """``source, source_size, target`` of each source of ``rows(source, size)``.

    Sources are ordered by code point (UTF-8 order), null last. The list of sources is
    gathered at the driver; more than ``MOST_SOURCES`` of them raise an error.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: the column names no mix")
    sums = [(r["source"], int(r["size"])) for r in found]
    sums.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    aims = targets([s for _, s in sums], [weights[i % len(weights)] for i in range(len(sums))], most)
    table = [(name, i, size, aim) for i, ((name, size), aim) in enumerate(zip(sums, aims, strict=True))]
    return rows.sparkSession.createDataFrame(table, "source string, source_no int, source_size long, target double")


def _settle(p: np.ndarray, rows: list[int]) -> list[int]:
    left = []
    for i in rows:
        if p[i] <= EPS:
            p[i] = 0.0
        elif p[i] >= 1 - EPS:
            p[i] = 1.0
        else:
            left.append(i)
    return left


def _flight(p: np.ndarray, size: np.ndarray, reserve: int = RESERVE) -> np.ndarray:
    """Walk until at most two documents are fractional; sums of p and of p * size are kept.

    Three fractional documents have one direction that changes neither sum: the cross
    product of the two constraint rows, (1, 1, 1) and their sizes. That walk tends to leave
    the largest documents open, so the last ``reserve`` of the order wait for them: there
    the direction is the largest open document's unit vector projected on the null space.
    What stays open at the end is small.
    """
    p = p.copy()
    open_ = _settle(p, range(len(p)))
    first, kept = open_[: max(0, len(open_) - reserve)], open_[max(0, len(open_) - reserve) :]
    hand: list[int] = []
    for nxt in first:
        hand.append(nxt)
        if len(hand) < 3:
            continue
        a, b, c = (float(size[i]) for i in hand)
        way = [c - b, a - c, b - a]
        if way == [0.0, 0.0, 0.0]:
            way = [1.0, -1.0, 0.0]
        step = min(((1 - p[i]) if w > 0 else p[i]) / abs(w) for i, w in zip(hand, way, strict=True) if w)
        for i, w in zip(hand, way, strict=True):
            p[i] += step * w
        hand = _settle(p, hand)
    rest = np.array(sorted([*hand, *kept], key=lambda i: -size[i]), dtype=np.int64)
    while len(rest) > 2:
        x = size[rest]
        basis = [np.ones(len(rest)) / np.sqrt(len(rest))]
        if (side := x - x.mean()).any():
            basis.append(side / np.linalg.norm(side))
        k = 0
        while True:  # a document that determines its own size's sum cannot move by itself
            way = -sum(q[k] * q for q in basis)
            way[k] += 1
            if np.abs(way).max() > 1e-7:
                break
            k += 1
        way[np.abs(way) < 1e-12] = 0
        up = np.where(way > 0, 1 - p[rest], p[rest])
        with np.errstate(divide="ignore"):
            p[rest] += way * (up / np.abs(way)).min()
        rest = rest[(p[rest] > EPS) & (p[rest] < 1 - EPS)]
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    return p


def _land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last fractional documents so that words, then documents, stay nearest."""
    p = p.copy()
    rest = np.flatnonzero((p > 0) & (p < 1))
    if len(rest):
        words, docs = float((p[rest] * size[rest]).sum()), float(p[rest].sum())
        best = min(
            itertools.product((0.0, 1.0), repeat=len(rest)),
            key=lambda v: (abs(float((np.array(v) * size[rest]).sum()) - words), abs(sum(v) - docs), v),
        )
        p[rest] = best
    return p


def _walker(last: bool):
    def walk(rows: pa.Table) -> pa.Table:
        # Ids stay in Arrow: a pandas column of long with a null would round them.
        order, size, p = (rows.column(c).to_numpy() for c in ("order", "size", "p"))
        by = np.lexsort((size, order))
        size = size[by].astype(np.float64)
        p = _flight(p[by], size)
        rows = rows.take(pa.array(by))
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(_land(p, size) if last else p))

    return walk


def cube_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST_TIMES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id, text_key long, source, size long, source_size long, target double,
    copies int, taken long`` with one row per input row. A source's taken words lie within
    about one document of its target. Documents without words may be taken too (0 words).
    Null sources form a source of their own, the last one; rows that repeat are drawn one by
    one. If no document has a word, all targets are 0 and nothing is taken. Draws depend
    only on the rows, so reruns agree.
    """
    spark = docs.sparkSession
    bound_batches(spark, 10_000)
    slim = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = materialize(
        slim.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")),
        "mix-sizes",
    )
    aims = source_targets(rows, weights, most)
    named = rows.join(F.broadcast(aims), rows["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    base = F.floor(ratio + EPS).cast("int")
    now = named.select(
        "doc_id", "text_key", "source", "size", "source_no", "source_size", "target", base.alias("base"),
        F.greatest(ratio - base, F.lit(0.0)).alias("p"), F.xxhash64("doc_id", "text_key", F.lit(3)).alias("order"),
    )
    counts = {r["source_no"]: r["n"] for r in named.groupBy("source_no").agg(F.count("*").alias("n")).collect()}
    return _levels(spark, now, counts, block_rows).select(
        "doc_id", "text_key", "source", "size", "source_size", "target",
        (F.col("base") + F.col("p")).cast("int").alias("copies"),
        (F.col("size") * (F.col("base") + F.col("p"))).cast("long").alias("taken"),
    )


def _levels(spark: SparkSession, rows: DataFrame, counts: dict[int, int], block_rows: int) -> DataFrame:
    settled: list[DataFrame] = []
    level = 0
    while True:
        most = max(counts.values(), default=0)
        last = most <= block_rows
        blocks = spark.createDataFrame([(s, max(1, -(-n // block_rows))) for s, n in sorted(counts.items())], "source_no int, blocks int")
        dealt = rows.drop("block").join(F.broadcast(blocks), "source_no")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), F.col("blocks"))).drop("blocks")
        moved = dealt.groupBy("source_no", "block").applyInArrow(_walker(last), dealt.schema)
        if last:
            return _union([*settled, moved])
        out = materialize(moved, f"mix-level{level}")
        fixed = (F.col("p") == 0) | (F.col("p") == 1)
        settled.append(out.where(fixed))
        rows = out.where(~fixed)
        found = {r["source_no"]: r["n"] for r in rows.groupBy("source_no").agg(F.count("*").alias("n")).collect()}
        if found and max(found.values()) >= most:
            raise RuntimeError("a level settled nothing")
        counts = found
        level += 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``, whatever their names.

    Null and empty texts have no words and are drawn like others. Rows equal in id, text and
    source share what the mix takes of them: as evenly as it goes, what is left over to those
    with the smallest hash of all columns (which must then be columns that can be grouped). No
    rows give no rows.
    """
    drawn = materialize(cube_mix(docs, id_col, text_col, source_col), "mix-drawn")
    col = lambda name: F.col(f"`{name}`")
    row, key, copies, same, place, time = fresh(docs, "row", "key", "copies", "same", "place", "time")
    name = lambda d, k, s: F.xxhash64(d.isNull(), d, k, s.isNull(), s)
    share = drawn.groupBy(name(F.col("doc_id"), F.col("text_key"), F.col("source")).alias(row), F.col("text_key").alias(key)).agg(
        F.sum("copies").alias(copies), F.count("*").alias(same)
    )
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(col(text_col), F.lit(""))))
    keyed = keyed.withColumn(row, name(col(id_col), F.col(key), col(source_col).cast("string")))
    share = materialize(share, "mix-share")
    joined = keyed.join(share.where(F.col(copies) > 0), [row, key])
    if not share.where(F.col(same) > 1).isEmpty():
        # Rows equal in all columns are one row with a count, so a hot row shrinks before it is exchanged.
        kinds = joined.where(F.col(same) > 1).groupBy(*[col(c) for c in [*docs.columns, row, key, copies, same]]).agg(F.count("*").alias(place))
        upto = F.sum(place).over(Window.partitionBy(row, key).orderBy(F.xxhash64(*[col(c) for c in docs.columns])).rowsBetween(Window.unboundedPreceding, -1))
        each, left = F.floor(F.col(copies) / F.col(same)), F.col(copies) % F.col(same)
        more = F.greatest(F.lit(0), F.least(F.col(place), left - F.coalesce(upto, F.lit(0))))
        kinds = kinds.withColumn(copies, (each * F.col(place) + more).cast("long"))
        joined = joined.where(F.col(same) == 1).select(*[col(c) for c in docs.columns], copies).unionByName(
            kinds.select(*[col(c) for c in docs.columns], copies)
        )
    times = joined.where(F.col(copies) > 0).withColumn(time, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return times.select(*[col(c) for c in docs.columns])
