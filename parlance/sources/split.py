"""Huge JSON arrays read in blocks: the elements of one file come from many tasks.

Spark's text reader cuts a file at closing braces, so every store that Spark reads will do. A
block does not know whether it begins inside a string, nor how deep. The first pass measures
each block both ways: strings swap with what is between them, and the depth changes by what
is outside. From these few numbers a block the driver tells where each block really begins; the second
pass cuts the elements at the commas of depth one, and elements across blocks are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, SLASH, COMMA = ord('"'), ord("\\"), ord(",")
_KIND = np.zeros(256, np.int8)
_KIND[[ord("["), ord("{")]] = 1
_KIND[[ord("]"), ord("}")]] = -1
_SIGN = _KIND != 0
_SIGN[COMMA] = True


def structure(raw: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """Positions of commas and brackets outside strings, the depth between which each stands, and the state after.

    A comma stands at the present depth, an opening bracket at the depth that it begins and a closing
    one at the depth that it ends.
    """
    buf = np.frombuffer(raw, np.uint8)
    quote = np.flatnonzero(buf == QUOTE)
    slash = buf == SLASH
    if len(quote) and slash.any():
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(buf))))
        before = np.where(quote > 0, plain[quote - 1], -1)
        quote = quote[(quote - 1 - before) % 2 == 0]
    at = np.flatnonzero(_SIGN[buf])
    at = at[(np.searchsorted(quote, at) + inside) % 2 == 0]
    kind = _KIND[buf[at]].astype(np.int64)
    after = depth + np.cumsum(kind)
    return at, after + (kind < 0), bool((len(quote) + inside) % 2), int(after[-1]) if len(at) else depth


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Rows of one block after the other, each row closed by the brace that the reader took."""
    files, starts, values = batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("value").to_pylist()
    a = 0
    for b in range(1, len(files) + 1):
        if b == len(files) or files[b] != files[a] or starts[b] != starts[a]:
            yield (files[a], starts[a]), b"".join(x for v in values[a:b] for x in (v, b"}"))
            a = b


def _after_junk(raw: bytes) -> bytes:
    """From the first bracket on; what stands before the root counts as junk."""
    found = [i for i in (raw.find(b"["), raw.find(b"{")) if i >= 0]
    return raw[min(found) :] if found else b""


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, start, root, flips, grown, levels``: what a block changes if it begins between strings, and inside one."""

    def close(key, root, state) -> pa.RecordBatch:
        out = {"file": [key[0]], "start": [key[1]], "root": [root], "flips": [state[0][0]]}
        out |= {"grown": [[s[1] for s in state]], "levels": [[sorted(s[2]) for s in state]]}
        return pa.RecordBatch.from_pydict(out, schema=_MEASURED)

    now, root, state = None, None, []
    for batch in batches:
        for key, raw in _runs(batch):
            if key != now:
                if now is not None:
                    yield close(now, root, state)
                now, root, state = key, None, [(False, 0, set()), (True, 0, set())]
            if key[1] == 0 and root is None:
                raw = _after_junk(raw)
                root = raw[:1].decode() or None
            for i, (inside, depth, levels) in enumerate(state):
                _, level, inside, depth = structure(raw, inside, depth)
                state[i] = inside, depth, levels | set(np.unique(level).tolist())
    if now is not None:
        yield close(now, root, state)


_MEASURED = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("root", pa.string()), ("flips", pa.bool_()), ("grown", pa.list_(pa.int64())), ("levels", pa.list_(pa.list_(pa.int64())))]
)
_PIECES = "file string, owner long, no int, at long, raw string, closed boolean, whole boolean"


def _blocks(measured: list) -> dict[tuple[str, int], tuple[bool, int, int | None]]:
    """For each block of a file with an array: inside a string, depth, and the block that began its first element."""
    out = {}
    file = None
    for r in sorted(measured, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, depth, owner, array = r["file"], False, 0, None, r["root"] == "["
        if not array:
            continue
        out[file, r["start"]] = inside, depth, owner
        if 1 - depth in r["levels"][inside]:
            owner = r["start"]
        depth += r["grown"][inside]
        inside ^= r["flips"]
    return out


def _cut(shared):
    """Blocks to elements; those that a block does not hold whole come as pieces with their owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "owner", "no", "at", "raw", "closed", "whole"]
        now, held, no, own = None, [], -1, False
        inside, depth, owner, begun = False, 0, None, False
        rows: dict[str, list] = {n: [] for n in names}

        def put(raw: bytes, closed: bool, whole: bool) -> None:
            mine = now[1] if own else owner
            if mine is None or not raw and not closed:
                return  # what stands before the array
            values = (now[0], mine, no if own else -1, now[1], raw.decode("utf-8", "replace"), closed, whole)
            for n, v in zip(names, values, strict=True):
                rows[n].append(v)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({n: pa.array(rows[n], t) for n, t in zip(names, _TYPES, strict=True)})
            for n in names:
                rows[n] = []
            return batch

        for batch in batches:
            for key, raw in _runs(batch):
                if key not in shared.value:
                    continue
                if key != now:
                    if now is not None:
                        put(b"".join(held), False, False)
                    now, held, no, own = key, [], -1, False
                    inside, depth, owner = shared.value[key]
                    begun = key[1] > 0
                if not begun:
                    raw = _after_junk(raw)
                    begun = bool(raw)
                at, level, inside, depth = structure(raw, inside, depth)
                a = 0
                for b in at[level == 1].tolist():
                    put(b"".join([*held, raw[a:b]]), True, own)
                    held, a, own, no = [], b + 1, True, no + 1
                held.append(raw[a:])
            if rows["file"]:
                yield flush()
        if now is not None:
            put(b"".join(held), False, False)
        if rows["file"]:
            yield flush()

    return run


_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``file, owner, no, raw`` of every element of the arrays in the files at ``path``, and the files without an array.

    ``owner`` and ``no`` tell the block that the element begins in and its place there. An element is
    whole once the comma or bracket behind it is there, so the rest of a file that breaks off is left out.
    The driver holds a few numbers a block of ``spark.sql.files.maxPartitionBytes``.
    """
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "}").text(path)
    rows = text.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.col("value").cast("binary").alias("value"))
    kind = "file string, start long, root string, flips boolean, grown array<long>, levels array<array<long>>"
    measured = rows.mapInArrow(_measure, kind).collect()
    shared = spark.sparkContext.broadcast(_blocks(measured))
    other = sorted({r["file"] for r in measured if r["start"] == 0 and r["root"] != "["})
    cut = rows.mapInArrow(_cut(shared), _PIECES)
    key = ["file", "owner", "no"]
    # A piece's number within its owner: the element that the owner left open is its last one.
    parts = F.array_sort(F.collect_list(F.struct("at", "no", "raw", "closed")))
    joined = cut.where("not whole").groupBy("file", "owner").agg(parts.alias("parts")).where(F.exists("parts", lambda p: p.closed))
    joined = joined.select("file", "owner", F.array_max(F.transform("parts", lambda p: p.no)).alias("no"), F.array_join(F.transform("parts", lambda p: p.raw), "").alias("raw"))
    every = cut.where("whole").select(*key, "raw").unionByName(joined)
    return every.where(F.trim("raw") != ""), other
