"""SimHash near-duplicates by covering locality-sensitive hashing.

Pagh's covering scheme ("Locality-sensitive Hashing without False Negatives", 2016): each bit
position of a block gets a non-zero vector of F_2^(r+1); table v (a non-zero vector too) compares
the positions whose vector has inner product 1 with v. If two blocks differ in at most r
positions, these give at most r linear equations in r+1 unknowns, so some v is orthogonal to
all of them and the pair meets in table v.

A fingerprint of several blocks has such tables for each block: two that differ in at most
``radius`` bits differ in at most ``radius // blocks`` of them in some block, and meet there. So
a wide fingerprint keeps the guarantee at a radius for which one block would need 2^(radius+1)
tables. Wide fingerprints measure similarity: shingle sets of a Jaccard similarity s have vectors
with the cosine 2s / (1 + s), whose angle is the share of bits that differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_batches, bound_batches, discard, fresh, materialize, pick, row_key, shuffle_parts
from parlance.llm.components import connected_components, join_hot

SEED = 42
WORD = 64
#: Fixed odd constants of the finish that makes further words of a fingerprint from a shingle's hash.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: A bucket with more distinct fingerprints is compared chunk against chunk by many tasks.
BUCKET_ROWS = 50_000
#: Buckets of up to so many rows are compared all at once, larger ones one by one.
SMALL = 16


@dataclass(frozen=True)
class Sketch:
    """``bits`` (64 times a whole number) over shingles of ``shingle`` words; links differ in ``radius`` bits
    or fewer. ``blocks`` of equal width hold the tables. ``distinct``: a repeated shingle counts once."""

    shingle: int = 4
    bits: int = 64
    radius: int = 4
    blocks: int = 1
    distinct: bool = False

    @property
    def words(self) -> int:
        return self.bits // WORD

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.words)]


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits that are to be expected of shingle sets of this Jaccard similarity."""
    return math.floor(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def similar(similarity: float = 0.8, shingle: int = 5, bits: int = 192) -> Sketch:
    """Sketch that links sets of ``shingle`` words with a Jaccard similarity of ``similarity`` or more, as SimHash measures it."""
    radius = radius_for(similarity, bits)
    blocks = next(b for b in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64) if bits % b == 0 and WORD % (bits // b) == 0 and radius // b <= 4)
    return Sketch(shingle, bits, radius, blocks, True)


def _further(h: np.ndarray, word: int) -> np.ndarray:
    x = h + np.uint64(word * STEP & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def _votes(h: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set; sums run in eight byte lanes of a word."""
    out = np.zeros(WORD, np.int64)
    for at in range(0, len(h), 255 * 64):
        part = h[at : at + 255 * 64]
        part = np.append(part, np.zeros(-len(part) % 255, np.uint64))
        lanes = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view("<u8")
        sums = lanes.reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
        out += sums.view(np.uint8).reshape(-1, WORD).sum(axis=0, dtype=np.int64)
    return out


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, A-Z lower-cased; fewer words are one run, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    line = b" ".join(words)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), last, strict=False)], dtype="<u8")


def simhash(text: bytes | None, how: Sketch = Sketch()) -> np.ndarray:
    """SimHash of one text as unsigned words; a bit is set if it is in over half the hashes, no words give 0."""
    h = shingle_hashes(text, how.shingle)
    if how.distinct and len(h) > 1:
        h = np.unique(h)
    out = np.zeros(how.words, np.uint64)
    if len(h):
        for w in range(how.words):
            bits = (_votes(_further(h, w) if w else h) * 2 > len(h)).astype(np.uint8)
            out[w] = np.packbits(bits, bitorder="little").view("<u8")[0]
    return out


def fingerprints(slim: DataFrame, how: Sketch) -> DataFrame:
    """``slim(doc_id, text)`` as ``doc_id, text_key long, f0 .. long``: the fingerprint's words as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [simhash(t, how) for t in b.column("text").to_pylist()]
            words = np.stack(rows).view(np.int64) if rows else np.empty((0, how.words), np.int64)
            own = [pa.array(np.ascontiguousarray(words[:, i])) for i in range(how.words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *own], names=["doc_id", "text_key", *how.columns])

    kind = slim.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    keyed = slim.select("doc_id", F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key long, " + ", ".join(f"{c} long" for c in how.columns))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def covering_masks(radius: int, positions: int = WORD, seed: int = 1) -> list[int]:
    """The 2^(radius+1)-1 masks over ``positions`` bits."""
    rows = 2 ** (radius + 1)
    vectors = [1 + i % (rows - 1) for i in range(positions)]
    order = np.random.default_rng(seed).permutation(positions)
    return [sum(1 << int(order[i]) for i in range(positions) if bin(vectors[i] & v).count("1") % 2) for v in range(1, rows)]


def tables(how: Sketch) -> list[tuple[int, int]]:
    """``(word, mask)`` of every table: the masks of each block, shifted to its place."""
    width = how.bits // how.blocks
    if WORD % width:
        raise ValueError("a block must lie inside one word")
    masks = covering_masks(how.radius // how.blocks, width)
    return [(b * width // WORD, m << (b * width % WORD)) for b in range(how.blocks) for m in masks]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _near(rows: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """Which of ``rows`` lie within the radius of which of ``others``, word by word to save memory."""
    d = np.zeros((len(rows), len(others)), np.uint16)
    for w in range(rows.shape[1]):
        d += np.bitwise_count(rows[:, w, None] ^ others[None, :, w])
    return d <= radius


def _linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """Rows that have another row within the radius."""
    out = np.zeros(len(fps), bool)
    block = max(1, (1 << 20) // len(fps))
    for a in range(0, len(fps), block):
        near = _near(fps[a : a + block], fps[a:], radius)
        near[np.arange(len(near)), np.arange(len(near))] = False
        out[a : a + len(near)] |= near.any(axis=1)
        out[a:] |= near.any(axis=0)
    return out


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows of one bucket, each a link, that span the components of its links.

    A search from each root compares only with what no root has reached yet, so a dense group
    costs little more than its size and no list of all its pairs ever exists.
    """
    rest = np.flatnonzero(_linked(fps, radius))
    ups, downs = [], []
    while len(rest):
        queue = [rest[:1]]
        rest = rest[1:]
        while queue and len(rest):
            block = queue.pop()
            most = max(1, (1 << 20) // len(rest))
            if len(block) > most:
                queue.append(block[most:])
                block = block[:most]
            near = _near(fps[block], fps[rest], radius)
            met = near.any(axis=0)
            if met.any():
                ups.append(block[near[:, met].argmax(axis=0)])
                downs.append(rest[met])
                queue.append(rest[met])
                rest = rest[~met]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *ups]), np.concatenate([none, *downs])


def _first_table(x: np.ndarray, every: list[tuple[int, int]]) -> np.ndarray:
    """The first table in which a pair of fingerprints meets; ``x`` has their differing bits."""
    first = np.full(len(x), len(every))
    for t in range(len(every) - 1, -1, -1):
        word, mask = every[t]
        first[(x[:, word] & np.uint64(mask)) == 0] = t
    return first


#: A bucket's name has the table in the bits from this one on.
TABLE_BIT = 48


def _edges(bucket: np.ndarray, fps: np.ndarray, how: Sketch, every: list[tuple[int, int]], most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``(row, row)`` of whole buckets, sorted by bucket, and the rows of buckets over ``most``."""
    n = len(bucket)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(start, n))
    left = np.repeat(start + size, size) - 1 - np.arange(n)
    left[np.repeat(size > SMALL, size)] = 0
    us, vs, step = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1
    i = np.flatnonzero(left >= 1)
    while len(i):
        hit = i[_distance(fps[i], fps[i + step]) <= how.radius]
        us.append(hit)
        vs.append(hit + step)
        step += 1
        i = i[left[i] >= step]
    over = []
    for k in np.flatnonzero(size > SMALL).tolist():
        a, b = int(start[k]), int(start[k] + size[k])
        if most is not None and b - a > most:
            over.append(np.arange(a, b))
            continue
        up, down = _forest(fps[a:b], how.radius)
        us.append(up + a)
        vs.append(down + a)
    u, v = np.concatenate(us), np.concatenate(vs)
    if most is not None and len(u):
        # A link that meets in an earlier table is left to it: its ends are connected there, by links
        # that meet there or earlier still.
        first = _first_table(fps[u] ^ fps[v], every) == bucket[u] >> TABLE_BIT
        u, v = u[first], v[first]
    return u, v, np.concatenate([np.empty(0, np.int64), *over])


def _linker(how: Sketch, every: list[tuple[int, int]], most: int | None):
    """Rows sorted by bucket to edges; members of buckets over ``most`` come out with their bucket instead."""
    names = [*(f"u{i}" for i in range(how.words)), *(f"v{i}" for i in range(how.words)), "bucket"]

    def batch(a: np.ndarray, b: np.ndarray, bucket) -> pa.RecordBatch:
        words = [pa.array(np.ascontiguousarray(x[:, i]).view(np.int64)) for x in (a, b) for i in range(how.words)]
        return pa.RecordBatch.from_arrays([*words, pa.nulls(len(a), pa.int64()) if bucket is None else pa.array(bucket)], names=names)

    def solve(bucket: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v, over = _edges(bucket, fps, how, every, most)
        for a in range(0, len(u), 50_000):
            yield batch(fps[u[a : a + 50_000]], fps[v[a : a + 50_000]], None)
        for a in range(0, len(over), 50_000):
            rows = over[a : a + 50_000]
            yield batch(fps[rows], fps[rows], bucket[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket, held_fps, passed_on = [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("bucket").to_numpy()
            fps = np.stack([b.column(c).to_numpy() for c in how.columns], axis=1).view(np.uint64)
            if passed_on is not None:  # the rest of a bucket that is too large to hold
                same = int(np.searchsorted(bucket, passed_on, side="right"))
                if same:
                    yield batch(fps[:same], fps[:same], bucket[:same])
                    bucket, fps = bucket[same:], fps[same:]
                if not len(bucket):
                    continue
                passed_on = None
            cut = int(np.searchsorted(bucket, bucket[-1], side="left"))  # the last bucket may go on
            if cut or (held_bucket and held_bucket[0][-1] != bucket[-1]):
                yield from solve(np.concatenate([*held_bucket, bucket[:cut]]), np.concatenate([*held_fps, fps[:cut]]))
                held_bucket, held_fps = [], []
            held_bucket.append(bucket[cut:])
            held_fps.append(fps[cut:])
            if most is not None and sum(map(len, held_bucket)) > most:
                yield from solve(np.concatenate(held_bucket), np.concatenate(held_fps))
                held_bucket, held_fps, passed_on = [], [], bucket[-1]
        if held_bucket:
            yield from solve(np.concatenate(held_bucket), np.concatenate(held_fps))

    return run


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_parts(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


def _deal(fps: DataFrame, how: Sketch, every: list[tuple[int, int]]) -> DataFrame:
    """One row per fingerprint and table; the bucket holds the table and 48 hash bits of what its mask selects."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    slots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(signed(m)).cast("long").alias("m")) for t, (w, m) in enumerate(every)])
    dealt = fps.select(*how.columns, F.explode(slots).alias("s"))
    word = F.col(how.columns[0])
    for i, c in enumerate(how.columns[1:], start=1):
        word = F.when(F.col("s.w") == i, F.col(c)).otherwise(word)
    hashed = F.xxhash64(word.bitwiseAND(F.col("s.m"))).bitwiseAND(F.lit((1 << TABLE_BIT) - 1))
    return _by_bucket(dealt.select(*how.columns, F.shiftleft(F.col("s.t").cast("long"), TABLE_BIT).bitwiseOR(hashed).alias("bucket")))


def _node(columns: list[str]) -> Column:
    """One long that names a fingerprint: itself, or XXH64 of its words if it has several."""
    return F.col(columns[0]) if len(columns) == 1 else F.xxhash64(*columns)


def links(fps: DataFrame, how: Sketch = Sketch(), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(u, v)`` between the nodes of distinct fingerprints ``fps(f0 .. long)``.

    They have the same connected components as all pairs within the radius: a bucket of few
    rows gives its pairs, a larger one a spanning forest. A bucket over ``bucket_rows`` is cut
    into chunks, and every two chunks are searched together by a task, so no task holds it.
    """
    spark = fps.sparkSession
    every = tables(how)
    both = [f"{x}{i}" for x in "uv" for i in range(how.words)]
    schema = ", ".join(f"{c} long" for c in [*both, "bucket"])
    with arrow_batches(spark, 50_000):
        first = materialize(_deal(fps, how, every).mapInArrow(_linker(how, every, bucket_rows), schema), "links")
        done = first.where("bucket is null")
        large = first.where("bucket is not null")
        if not large.isEmpty():
            sizes = large.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / (bucket_rows / 2)).cast("int"))
            own = large.select(*[F.col(f"u{i}").alias(c) for i, c in enumerate(how.columns)], "bucket")
            own = join_hot(own, sizes, "bucket", large.count())
            own = own.withColumn("mine", F.pmod(F.xxhash64(*how.columns, F.lit(9)), F.col("chunks")).cast("int"))
            pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            name = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
            again = _by_bucket(pairs.select(*how.columns, name.alias("bucket")))
            done = done.unionByName(materialize(again.mapInArrow(_linker(how, every, None), schema), "chunk-links"))
    nodes = lambda x: _node([f"{x}{i}" for i in range(how.words)])
    return done.select(nodes("u").alias("u"), nodes("v").alias("v"))


def _groups(docs: DataFrame, id_col: str, text_col: str, how: Sketch) -> tuple[DataFrame, DataFrame]:
    """``marks(doc_id, text_key, f0 ..)`` of all rows, and ``classes(f0 .., node, low, n, root)`` of the distinct fingerprints."""
    bound_batches(docs.sparkSession)
    marks = materialize(fingerprints(pick(docs, doc_id=id_col, text=text_col), how), "simhash")
    classes = marks.groupBy(*how.columns).agg(F.min("doc_id").alias("low"))
    classes = materialize(classes.select(*how.columns, _node(how.columns).alias("node"), "low"), "simhash-classes")
    parts = connected_components(links(classes.select(*how.columns), how))
    rooted = classes.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return marks, materialize(rooted, "simhash-roots")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Sketch = Sketch()) -> DataFrame:
    """Every document with its SimHash and the smallest id of its component.

    Returns ``id_col, text_key long, f0 .. long, root long, component_id`` with one row per input
    row; ``text_key`` is XXH64 of the text and ``root`` names the component. Null texts count as
    empty, and texts without words have fingerprint 0 and link like any other. Ties and
    repeated rows have equal fingerprints and so one component. A component whose ids are all
    null has a null ``component_id``; ids that repeat are kept as rows. Very long texts are
    read whole. Other columns of ``docs`` take no part, whatever their names. No rows give no rows.
    """
    marks, classes = _groups(docs, id_col, text_col, how)
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = join_hot(classes.select(*how.columns, "root"), lows, "root", classes.count()).drop("n")
    return marks.join(named, how.columns).select(F.col("doc_id").alias(id_col), "text_key", *how.columns, "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Sketch = similar()) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays.

    It is the row with the smallest id, nulls last, ties to the smaller text hash; of rows
    equal in both, one stays. Null and empty texts and texts without words are copies of each
    other. All columns are returned as they are, whatever their names. No rows give no rows.
    """
    marks, classes = _groups(docs, id_col, text_col, how)
    found = materialize(marks.join(classes.select(*how.columns, "root"), how.columns).select("doc_id", "text_key", "root"), "simhash-found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    row, key = fresh(docs, "row", "key")
    stay = best.select(row_key(F.col("best.id"), F.col("best.key")).alias(row), F.col("best.key").alias(key))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    keyed = keyed.withColumn(row, row_key(F.col(f"`{id_col}`"), F.col(key)))
    out = keyed.join(materialize(stay, "simhash-kept"), [row, key], "left_semi")
    repeated = not found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    discard(marks, classes, found)
    return (out.dropDuplicates([row, key]) if repeated else out).drop(row, key)
