"""Removal of long repeats with a run-length index.

What has to be found are the positions whose next ``length`` bytes start anywhere else too.
The work is dealt out by anchors: the anchor of a window of ``length`` bytes is its smallest
hashed k-byte string (a minimizer), so equal windows have equal anchors. Neighbouring windows
of one text with the same anchor make a piece, and pieces can only match inside their
anchor's group. Anchors that occur once are done; equal pieces enter an index once.

A task indexes a bounded set of pieces. It sorts their suffixes, keeps the Burrows-Wheeler
transform as runs with the suffix samples at the run ends, and streams matching statistics:
at a run's head the match with the suffix before it (the sample at the end of the run before)
is measured; from there along the text the length falls by one a byte until the next sample,
which is how LCP values behave inside runs. The same holds for the suffix after, from the run
ends. Positions with a match of ``length`` or more are marked. Repetitive pieces have few runs.

An anchor with more bytes of different pieces than a task should hold is split by a second
anchor: its pieces are cut again under another hash, and the parts meet in groups of both
anchors, in indexes like the others. What is hot after ``levels`` such cuts (windows that lie in
one common passage almost wholly) is counted by 128-bit hash of the window, exact as well.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bound_batches, discard, fresh, materialize, pick, scratch_path, shuffle_parts
from parlance.llm.components import join_hot

#: Fixed odd constants of the rolling hash and its finish.
BASE, FINISH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1
#: Positions that are hashed at once, so that the steps between stay in a core's cache.
BLOCK = 1 << 15


@dataclass(frozen=True)
class Repeats:
    """``length``: bytes of a match; ``anchor``: bytes of an anchor string; ``index_bytes``: one
    index's target; ``hot_bytes``: an anchor with more bytes of different pieces is split by a further
    anchor, at most ``levels`` times."""

    length: int = 400
    anchor: int = 32
    index_bytes: int = 500_000
    hot_bytes: int = 2_000_000
    chunk: int = 1 << 18
    levels: int = 3


@dataclass(frozen=True)
class Passages:
    """A repeated run is a passage if it has ``words`` words, or ``long`` bytes in whatever script.

    Repeats are looked for from ``length`` bytes on, so a passage of ``words`` words that is shorter is not seen.
    """

    words: int = 50
    long: int = 400
    length: int = 160

    def holds(self, run: bytes) -> bool:
        return len(run) >= self.long or len(run.split()) >= self.words


def _rolling(buffer: np.ndarray, k: int, level: int = 0) -> np.ndarray:
    """Hash of the k bytes at each position, another one at each level; k is a power of two."""
    out = np.empty(max(len(buffer) - k + 1, 0), np.uint64)
    for at in range(0, len(out), BLOCK):
        h = buffer[at : at + BLOCK + k - 1].astype(np.uint64)
        h += np.uint64(1)
        base, step = BASE, 1
        while step < k:
            left = h[:-step] * np.uint64(base)
            left += h[step:]
            h, base, step = left, base * base & MASK, step * 2
        h += np.uint64(level * FINISH & MASK)
        h ^= h >> np.uint64(29)
        h *= np.uint64(FINISH)
        h ^= h >> np.uint64(32)
        out[at : at + BLOCK] = h
    return out


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` keys."""
    least = np.empty(max(len(keys) - width + 1, 0), keys.dtype)
    for at in range(0, len(least), BLOCK):
        out, have = keys[at : at + BLOCK + width - 1], 1
        while have < width:
            step = min(have, width - have)
            out = np.minimum(out[:-step], out[step:])
            have += step
        least[at : at + BLOCK] = out
    return least


def pieces(texts: list[bytes], how: Repeats, level: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """``text number, start, bytes, anchor hash`` of the pieces of the texts, chunk by chunk, and their bytes.

    A chunk holds several texts or a part of a long one; a part overlaps the next by
    ``length - 1`` bytes, so that each window lies in exactly one chunk.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for no, text in enumerate(texts):
        for at in range(0, len(text) - how.length + 1, how.chunk):
            part = text[at : at + how.chunk + how.length - 1] if len(text) > how.chunk else text
            held.append((no, at, part))
            size += len(part)
            if size >= how.chunk:
                yield _chunk_pieces(held, how, level)
                held, size = [], 0
            if part is text:
                break
    if held:
        yield _chunk_pieces(held, how, level)


def _chunk_pieces(held: list[tuple[int, int, bytes]], how: Repeats, level: int) -> tuple[np.ndarray, ...]:
    raw = b"".join(p for _, _, p in held)
    buffer = np.frombuffer(raw, np.uint8)
    h = _rolling(buffer, how.anchor, level)
    low = np.uint64((1 << 24) - 1)
    keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    where = (_smallest(keys, how.length - how.anchor + 1) & low).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    own = np.repeat(np.arange(len(held)), sizes)[: len(where)]
    inside = np.arange(len(where)) + how.length <= ends[own]
    new = np.ones(len(where), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    no = np.array([n for n, _, _ in held])[own[first]]
    start = first - begins[own[first]] + np.array([a for _, a, _ in held])[own[first]]
    digest = xxhash.xxh3_64_intdigest
    length = stop - first + how.length - 1
    same = np.fromiter((digest(raw[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)), dtype=np.uint64, count=len(first))
    return no, start, length, h[where[first]], same


def _eights(symbols: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes at each position as one integer, the last ones filled up with zeros; ``order``: ``<`` or ``>``."""
    n = len(symbols)
    rows = -(-n // 8)
    raw = np.concatenate([symbols, np.zeros(8 * rows + 8 - n, np.uint8)])
    out = np.empty((rows, 8), np.uint64)
    for j in range(8):
        out[:, j] = np.frombuffer(raw, f"{order}u8", rows, j)
    return out.reshape(-1)[:n]


def _first_keys(code: np.ndarray, rest: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """The first symbols at each position, up to the end sign, as one integer, and how many they are.

    Eight where the symbols fit in a byte; no UTF-8 text has the byte 255, which does not, and then seven.
    """
    n = len(code)
    if code.max() < 256:
        key = _eights(code.astype(np.uint8), ">")
        for j in range(8):
            key[ends[sizes > j] - j] &= np.uint64(MASK ^ ((1 << 8 * (8 - j)) - 1))
        return key, 8
    key = np.zeros(n, np.uint64)
    for j in range(7):
        digit = np.zeros(n, np.uint64)
        digit[: max(n - j, 0)] = code[j:]
        digit[rest < j] = 0
        key = key * np.uint64(257) + digit
    return key, 7


def _changes(key: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return new


def suffix_order(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the parts, each closed by an end sign of its own, smaller than any byte.

    Returns the order, the text as 16-bit symbols (0: end sign), each position's distance to its end sign and
    its part. Prefix doubling from the first symbols on; settled suffixes leave the sorting. Suffixes that
    reach an end sign are settled by its place, so that the others have all symbols that are compared.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    n = int(sizes.sum())
    ends = np.cumsum(sizes) - 1
    code = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    code[ends] = 0
    part = np.repeat(np.arange(len(parts)), sizes)
    rest = np.repeat(ends, sizes) - np.arange(n)
    key, width = _first_keys(code, rest, ends, sizes)
    order = np.argsort(key)
    key = key[order]
    new = _changes(key)
    slots = np.arange(n)
    near = np.zeros(n, bool)
    for j in range(width):
        near[ends[sizes > j] - j] = True
    ended = np.flatnonzero(near[order])
    order[ended] = order[ended][np.lexsort((order[ended], key[ended]))]
    new[ended] = True
    first = np.maximum.accumulate(np.where(new, slots, 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    at, bits = order, n.bit_length()
    while True:
        tied = ~new
        tied[:-1] |= tied[1:]
        if not tied.any():
            return order, code, rest, part
        slots, at, first = slots[tied], at[tied], first[tied]
        if 3 * bits < 64:  # place, next rank and position in one integer: sorted without an index
            key = ((first << bits | rank[at + width]) << bits) | at
            key.sort()
            at = key & ((1 << bits) - 1)
            key >>= bits
        else:
            key = first << bits | rank[at + width]
            by = np.argsort(key)
            key, at = key[by], at[by]
        order[slots] = at
        new = _changes(key)
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[at] = first
        width *= 2


@dataclass
class RunIndex:
    """Run-compressed transform: the symbol of each run and the suffixes at its head and its end."""

    symbol: np.ndarray
    head: np.ndarray
    tail: np.ndarray


def run_index(order: np.ndarray, code: np.ndarray) -> RunIndex:
    """Runs of the transform; every end sign is a run of its own."""
    before = code[order - 1]
    before[order == 0] = 0
    cut = np.append(True, (before[1:] != before[:-1]) | (before[1:] == 0))
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(order)) - 1
    return RunIndex(before[heads], order[heads], order[tails])


def _common(words: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bytes of the suffixes at a and b, up to the nearer end sign."""
    most = np.minimum(rest[a], rest[b])
    out = most.copy()
    live = np.arange(len(a))
    done = 0
    while len(live):
        x = words[np.minimum(a[live] + done, len(words) - 1)] ^ words[np.minimum(b[live] + done, len(words) - 1)]
        differ = x != 0
        if differ.any():
            bits = x[differ]
            first = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
            out[live[differ]] = np.minimum(most[live[differ]], done + first)
        done += 8
        live = live[~differ & (most[live] > done)]
    return out


def matching_statistics(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte (end signs included) of the joined parts: the longest match that starts anywhere
    else, inside both parts; and the part that it lies in."""
    order, code, rest, part = suffix_order(parts)
    runs = run_index(order, code)
    n = len(order)
    words = _eights((code - 1).astype(np.uint8), "<")
    found = np.zeros(n, np.int64)
    for mine, other, edge in ((runs.head[1:], runs.tail[:-1], runs.head[0]), (runs.tail[:-1], runs.head[1:], runs.tail[-1])):
        sample = np.full(n, -1, np.int64)
        reach = np.zeros(n, np.int64)
        sample[mine] = mine
        reach[mine] = mine + _common(words, rest, mine, other)
        sample[edge], reach[edge] = edge, edge  # the first suffix has none before it, the last none after
        last = np.maximum.accumulate(sample)
        found = np.maximum(found, np.where(last >= 0, reach[last] - np.arange(n), 0))
    return np.minimum(found, rest), part


_COVER = "anchor long, same long, low int, high int"


def _index_pieces(how: Repeats):
    """Pieces sorted by bucket to ``anchor, same, low, high``: the bytes that repeated windows cover."""

    def solve(anchor: list, same: list, parts: list[bytes]) -> pa.RecordBatch:
        stat, part = matching_statistics(parts)
        hit = np.flatnonzero(stat >= how.length)
        own = part[hit]
        sizes = np.array([len(p) + 1 for p in parts])
        begin = np.cumsum(sizes) - sizes
        first = np.append(True, own[1:] != own[:-1]) if len(own) else np.empty(0, bool)
        last = np.append(first[1:], True) if len(own) else first
        who = own[first]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(anchor, np.int64)[who]),
                pa.array(np.array(same, np.int64)[who]),
                pa.array((hit[first] - begin[who]).astype(np.int32)),
                pa.array((hit[last] - begin[who] + how.length).astype(np.int32)),
            ],
            names=["anchor", "same", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchor, same, parts = None, [], [], []
        for b in batches:
            for bucket, a, s, body in zip(b.column("bucket").to_pylist(), b.column("anchor").to_pylist(), b.column("same").to_pylist(), b.column("body"), strict=True):
                if bucket != now and parts:
                    yield solve(anchor, same, parts)
                    anchor, same, parts = [], [], []
                now = bucket
                anchor.append(a)
                same.append(s)
                parts.append(body.as_py())
        if parts:
            yield solve(anchor, same, parts)

    return run


def _windows(how: Repeats):
    """Pieces of hot anchors to their windows: ``anchor, same, at, w1, w2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, s, body in zip(b.column("anchor").to_pylist(), b.column("same").to_pylist(), b.column("body"), strict=True):
                body = body.as_py()
                n = len(body) - how.length + 1
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[i : i + how.length]) for i in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, a)), pa.array(np.full(n, s)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))],
                    names=["anchor", "same", "at", "w1", "w2"],
                )

    return run


def _text_table(docs: DataFrame, text_col: str) -> DataFrame:
    """Each different text once, with its 128-bit key and count, bucketed by key: joins on the key do not move it.

    The table is registered only while it is written; its files stay for what reads them later.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = pick(docs, text=text_col).select(*_keys(F.col("text")), text.alias("text"))
    once = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    name = f"parlance_texts_{uuid.uuid4().hex}"
    writer = once.write.option("path", scratch_path(spark, "texts")).option("compression", "zstd")
    writer.bucketBy(shuffle_parts(spark), "k1", "k2").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _keys(text) -> list:
    text = F.coalesce(text.cast("binary"), F.lit(b""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(17), text, F.lit(29)).alias("k2")]


def _gathered(covers: DataFrame) -> DataFrame:
    """``k1, k2, low, high`` as ``k1, k2, spans array<struct<low, high>>``."""
    return covers.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def repeated_spans(holders: DataFrame, how: Repeats, level: int = 0) -> DataFrame:
    """``k1, k2, low, high``: bytes of the holders ``k1, k2, text, n`` that lie in repeats; spans may overlap.

    ``n`` is how often a text stands in the corpus. From level 1 on holders are pieces of hot
    anchors (``k1`` is the anchor), whose parts meet only inside their anchor's group.
    """
    spark = holders.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, times = (b.column(c).to_numpy() for c in ("k1", "k2", "n"))
            for no, start, length, anchor, same in pieces([t.as_py() for t in b.column("text")], how, level):
                if level:
                    anchor = (anchor ^ k1[no].view(np.uint64)) * np.uint64(FINISH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(same.view(np.int64)), pa.array(k1[no]), pa.array(k2[no]), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(times[no])],
                    names=["anchor", "same", "k1", "k2", "start", "size", "n"],
                )

    long_ = holders.where(F.octet_length("text") >= how.length).select("k1", "k2", "text", "n")
    every = materialize(long_.mapInArrow(cut, "anchor long, same long, k1 long, k2 long, start int, size int, n long"), "pieces")
    again = (
        every.groupBy("anchor")
        .agg(F.sum("n").alias("times"), F.min("same").alias("s0"), F.max("same").alias("s1"), F.count("*").alias("rows"))
        .where("times > 1")
        .select("anchor", (F.col("s0") != F.col("s1")).alias("varied"), F.col("rows").alias("n"))
    )
    again = materialize(again, "repeated-anchors")
    found = materialize(join_hot(every.withColumnRenamed("n", "times"), again, "anchor", every.count()).drop("n"), "repeated-pieces")
    discard(every, again)
    alike = found.where("not varied").select("k1", "k2", F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high"))

    varied = found.where("varied")
    kinds = varied.groupBy("anchor", "same").agg(F.sum("times").alias("times"), F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "size")).alias("one"))
    kinds = materialize(kinds, "piece-kinds")
    groups = kinds.groupBy("anchor").agg(F.sum(F.col("one.size") + 1).alias("bytes"), F.count("*").alias("n"))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    indexes = max(1, -(-int(total) // how.index_bytes))
    hot = groups.where(F.col("bytes") > how.hot_bytes).select("anchor")
    any_hot = not hot.isEmpty()
    marked = kinds.join(hot.withColumn("hot", F.lit(True)), "anchor", "left") if any_hot else kinds.withColumn("hot", F.lit(False))
    wanted = marked.groupBy(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2")).agg(
        F.collect_list(F.struct("anchor", "same", "times", F.col("one.start").alias("start"), F.col("one.size").alias("size"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("want")
    )
    body = F.substring(F.col("text"), F.col("w.start") + 1, F.col("w.size"))
    bodies = holders.join(wanted, ["k1", "k2"]).select("text", F.explode("want").alias("w")).select("w.anchor", "w.same", "w.times", "w.hot", body.alias("body"))
    if any_hot:
        bodies = materialize(bodies, "piece-bodies")
    cool = bodies.where("not hot").select(F.pmod(F.xxhash64("anchor"), F.lit(indexes)).alias("bucket"), "anchor", "same", "body")
    cool = cool.repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket", "anchor", "same")
    covers = cool.mapInArrow(_index_pieces(how), _COVER)
    if any_hot:
        rows = bodies.where("hot")
        if level < how.levels:
            inner = rows.select(F.col("anchor").alias("k1"), F.col("same").alias("k2"), F.col("body").alias("text"), F.col("times").alias("n"))
            hits = repeated_spans(inner, how, level + 1).select(F.col("k1").alias("anchor"), F.col("k2").alias("same"), "low", "high")
        else:
            each = materialize(rows.select("anchor", "same", "body").mapInArrow(_windows(how), "anchor long, same long, at int, w1 long, w2 long"), "hot-windows")
            twice = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
            hits = join_hot(each, twice, ["w1", "w2"], each.count()).select("anchor", "same", F.col("at").alias("low"), (F.col("at") + how.length).alias("high"))
        covers = covers.unionByName(hits)
    whole = kinds.where("times > 1").select("anchor", "same", F.lit(0).alias("low"), F.col("one.size").alias("high"))
    # All windows of a piece hold its anchor, so what they cover is one span.
    covers = covers.unionByName(whole).groupBy("anchor", "same").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    covers = materialize(kinds.select("anchor", "same", "n").join(covers, ["anchor", "same"]), "covers")
    placed = join_hot(varied, covers, ["anchor", "same"], varied.count())
    placed = placed.select("k1", "k2", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    done = materialize(alike.unionByName(placed), "repeats")
    discard(found, kinds, covers, *([bodies] if any_hot else []))
    return done


def _runs(length: int):
    """Merged spans of ``length`` bytes or more with their bytes: ``k1, k2, at, p1, p2, n, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, n, text, spans in zip(*(b.column(c) for c in ("k1", "k2", "n", "text", "spans")), strict=True):
                found = merge_spans(np.array([(s["low"], s["high"]) for s in spans.as_py()], np.int64).reshape(-1, 2))
                found = found[found[:, 1] - found[:, 0] >= length]
                if not len(found):
                    continue
                text = text.as_py()
                parts = [text[a:z] for a, z in found.tolist()]
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in parts), "<i8").reshape(-1, 2)
                same = lambda x: pa.array(np.full(len(parts), x.as_py(), np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [same(k1), same(k2), pa.array(found[:, 0].astype(np.int32)), pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])), same(n), pa.array(parts, pa.binary())],
                    names=["k1", "k2", "at", "p1", "p2", "n", "text"],
                )

    return run


def spans_inside(texts: DataFrame, outer: DataFrame, how: Repeats) -> DataFrame:
    """Spans of ``how.length`` bytes, looked for only where shorter strings repeat: ``outer(k1, k2, spans)``.

    All shorter strings inside a repeat are repeats too, so each lies whole in a merged span of
    the outer ones. Equal spans are searched once.
    """
    schema = "k1 long, k2 long, at int, p1 long, p2 long, n long, text binary"
    runs = materialize(texts.join(outer, ["k1", "k2"]).mapInArrow(_runs(how.length), schema), "outer-runs")
    kinds = runs.groupBy("p1", "p2").agg(F.first("text").alias("text"), F.sum("n").alias("n"), F.count("*").alias("rows"))
    kinds = materialize(kinds, "outer-kinds")
    inner = repeated_spans(kinds.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "text", "n"), how)
    found = _gathered(inner).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "spans")
    found = materialize(found.join(kinds.select("p1", "p2", F.col("rows").alias("n")), ["p1", "p2"]), "outer-found")
    placed = join_hot(runs.select("k1", "k2", "at", "p1", "p2"), found, ["p1", "p2"], runs.count())
    placed = placed.select("k1", "k2", "at", F.explode("spans").alias("s"))
    done = materialize(placed.select("k1", "k2", (F.col("at") + F.col("s.low")).alias("low"), (F.col("at") + F.col("s.high")).alias("high")), "inner-repeats")
    discard(runs, kinds, inner, found)
    return done


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans ``(n, 2)``; spans that touch become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def _keep(text: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return text
    edges = [0, *spans.reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Shrink spans so that no UTF-8 character is cut."""
    out = []
    for a, b in spans.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _merged(spans: pa.Scalar) -> np.ndarray:
    return merge_spans(np.array([(s["low"], s["high"]) for s in spans.as_py() or []], np.int64).reshape(-1, 2))


def _digests(passages: Passages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {c: [] for c in ("k1", "k2", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")}
            for k1, k2, text, spans, outer in zip(*(b.column(c) for c in ("k1", "k2", "text", "spans", "outer")), strict=True):
                text = text.as_py()
                found = _merged(spans)
                kept = _keep(text, found)
                runs = [r for r in (text[a:z] for a, z in _merged(outer).tolist()) if passages.holds(r)]
                values = (k1.as_py(), k2.as_py(), len(text) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), len(runs), sum(map(len, runs)))
                for c, v in zip(rows, values, strict=True):
                    rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows)

    return run


def _cut_texts(passages: Passages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {"k1": [], "k2": [], "kept": [], "blank": []}
            for k1, k2, text, spans in zip(*(b.column(c) for c in ("k1", "k2", "text", "spans")), strict=True):
                text = text.as_py()
                found = [s for s in _merged(spans).tolist() if passages.holds(text[s[0] : s[1]])]
                found = _whole_characters(text, np.array(found, np.int64).reshape(-1, 2))
                if len(found):
                    kept = _keep(text, found).decode("utf-8", "replace")
                    for c, v in zip(rows, (k1.as_py(), k2.as_py(), kept, not kept.strip()), strict=True):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("kept", pa.string()), ("blank", pa.bool_())]))

    return run


def remove_repeats(
    docs: DataFrame, how: Repeats = Repeats(), passages: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes`` of each row.

    Every byte covered by a string of ``how.length`` bytes that also starts anywhere else in
    the table goes, in all its places, judged on the texts as they came. ``n_passages`` and
    ``passage_bytes`` count the repeated runs that are ``passages``; they may be shorter than
    ``how.length`` and then stay. A null text counts as empty; rows that repeat are copies of
    each other, so a repeated row of ``how.length`` bytes or more goes whole. Very long texts
    are cut into overlapping parts for the search and lose no match. Other columns take no part,
    whatever their names. No rows give no rows.
    """
    bound_batches(docs.sparkSession)
    texts = _text_table(docs, text_col)
    short = Repeats(min(passages.length, how.length), how.anchor, how.index_bytes, how.hot_bytes, how.chunk, how.levels)
    outer = materialize(_gathered(repeated_spans(texts, short)), "outer-spans")
    spans = materialize(_gathered(spans_inside(texts, outer, how)), "inner-spans")
    slim = pick(docs, doc_id=id_col, text=text_col)
    mine = slim.select("doc_id", *_keys(F.col("text")), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    joined = texts.select("k1", "k2", "text").join(outer.withColumnRenamed("spans", "outer"), ["k1", "k2"], "left").join(spans, ["k1", "k2"], "left")
    kind = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long"
    done = joined.mapInArrow(_digests(passages), kind)
    return mine.join(done, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")


def cut_repeats(docs: DataFrame, how: Repeats = Repeats(160), passages: Passages = Passages(), text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text, at whole characters, all other columns as they are, whatever their names.

    Repeats of ``how.length`` bytes are searched, and of the merged runs those that are
    ``passages`` are cut in all their places. Texts of which nothing but white space is left are
    dropped; a null or empty text stays as it is. Rows that repeat are copies of each other and
    go if they are passages. No rows give no rows.
    """
    bound_batches(docs.sparkSession)
    texts = _text_table(docs, text_col)
    spans = _gathered(repeated_spans(texts, how))
    done = texts.select("k1", "k2", "text").join(spans, ["k1", "k2"]).mapInArrow(_cut_texts(passages), "k1 long, k2 long, kept string, blank boolean")
    first, second, kept, blank = fresh(docs, "k1", "k2", "kept", "blank")
    done = done.select(F.col("k1").alias(first), F.col("k2").alias(second), F.col("kept").alias(kept), F.col("blank").alias(blank))
    text = F.col(f"`{text_col}`")
    k1, k2 = _keys(text)
    out = docs.withColumn(first, k1).withColumn(second, k2).join(done, [first, second], "left").where(~F.coalesce(F.col(blank), F.lit(False)))
    return out.select(*[(F.coalesce(F.col(kept), text).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
