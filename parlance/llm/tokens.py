"""Token counts and ids of a byte-level BPE tokenizer by the whole-token shortcut.

Byte-level BPE first cuts a text into pre-tokens by a pattern and then merges inside each
pre-token alone. Before any text is read, the driver proves with the library which strings
of the vocabulary come out as one token; pre-tokens among these need no merges, the others
are merged once by the library and remembered.

The merges themselves run in a rank-based merger, which joins the neighbours whose joint string
has the lowest rank. It gives the library's result if every string of the vocabulary comes out
of the library's merges as one token and ranks follow the order of the merges: when a token's
span is about to be joined, nothing has crossed the span's ends, so its inside looks as it does
alone, and alone it ends in the one listed pair. Both conditions are checked with the proofs.

The pattern runs in Python. A second proof compares its character classes with the library's
for every code point of the basic plane; texts with a code point on which they differ, or
one beyond that plane, go to the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from tokenizers import Tokenizer

from parlance.llm.common import bound_batches, pick

#: Fixed value: the pattern by which byte-level BPE of this vocabulary cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same without looking ahead, which the merger runs faster: it cuts alike where no two signs of white space meet.
PLAIN_PATTERN = PATTERN.replace(r"\s+(?!\S)|", "")
#: White space of the pattern beyond ASCII, and a table that turns that of ASCII into spaces.
FAR_SPACES = [(0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)
#: Remembered pre-tokens of one worker; beyond it, the store starts anew.
MOST_KNOWN = 400_000


@dataclass(frozen=True)
class Shortcut:
    """What the proofs found: the tokenizer, whole tokens with ids, special strings, the code points on
    which our cuts (``odd``) or the merger's (``odd_whole``) differ, and the merger's ranks."""

    definition: str
    whole: dict[str, int]
    special: dict[str, int]
    odd: list[tuple[int, int]]
    odd_whole: list[tuple[int, int]]
    ranks: dict[bytes, int]


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE shows printable Latin-1 bytes as themselves and the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _whole_tokens(tok: Tokenizer, vocab: dict[str, int]) -> dict[str, int]:
    byte = _byte_of_char()
    texts = []
    for name in sorted(vocab):
        try:
            texts.append(bytes(byte[c] for c in name).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue  # not a whole text: it cannot be a pre-token
    found = tok.encode_batch(texts, add_special_tokens=False)
    return {t: e.ids[0] for t, e in zip(texts, found, strict=True) if len(e.ids) == 1}


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    """Ranges of the code points, and all beyond the basic plane."""
    out: list[tuple[int, int]] = []
    for c in sorted(set(points)):
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return [*out, (0x10000, 0x10FFFF)]


def _blocks() -> Iterator[list[str]]:
    for start in range(0, 0x10000, 1024):
        yield [chr(c) for c in range(start, start + 1024) if not 0xD800 <= c < 0xE000]


def _any_of(ranges: list[tuple[int, int]]):
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]").search


def _probe(c: str) -> str:
    """A code point between a letter and a digit, and between signs."""
    return f"a{c}1 \n!{c}! \n"


def _odd_code_points(tok: Tokenizer, pattern) -> list[tuple[int, int]]:
    """Code points for which the library's cuts and ours differ."""
    odd = []
    cut = tok.pre_tokenizer.pre_tokenize_str
    for block in _blocks():
        parts = list(map(_probe, block))
        text = "".join(parts)
        differ = {m.span() for m in pattern.finditer(text)} ^ {s for _, s in cut(text)}
        ends = np.cumsum([len(p) for p in parts])
        for a, b in differ:
            odd += block[int(np.searchsorted(ends, a, side="right")) : int(np.searchsorted(ends, b - 1, side="right")) + 1]
    return _ranges(list(map(ord, odd)))


def _odd_for_merger(tok: Tokenizer, ranks: dict[bytes, int], special: dict[str, int]) -> list[tuple[int, int]]:
    """Code points for which the merger's cuts of whole texts, by either pattern, differ from the library's."""
    full, plain = merger(ranks, special), merger(ranks, special, PLAIN_PATTERN)
    odd = []
    for block in _blocks():
        for of, probe in ((full, _probe), (plain, _plain_probe)):
            texts = list(map(probe, block))
            theirs = tok.encode_batch(texts, add_special_tokens=False)
            odd += [ord(c) for c, t, e in zip(block, texts, theirs, strict=True) if of.encode_ordinary(t) != e.ids and not (of is plain and _spaced(t))]
    return _ranges(odd)


def _plain_probe(c: str) -> str:
    """A code point beside letters, digits, signs and itself, and between them and white space."""
    return f"a{c}1 {c}b{c}{c}!{c}!\n{c} a1{c}\t!"


_far_space = _any_of(FAR_SPACES)


def _spaced(text: str) -> bool:
    """Whether two signs of white space may meet."""
    return bool(_far_space(text)) or b"  " in text.encode("utf-8", "surrogatepass").translate(SPACES)


def _proved_ranks(tok: Tokenizer, vocab: dict[str, int], merges: list, special: dict[str, int]) -> dict[bytes, int]:
    byte = _byte_of_char()
    names = [n for n in vocab if n not in special]
    ranks = {bytes(byte[c] for c in n): vocab[n] for n in names}
    for n in names:
        if len(tok.model.tokenize(n)) != 1:
            raise ValueError("a string of the vocabulary does not merge to one token")
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    singles = {i for b, i in ranks.items() if len(b) == 1}
    if made != sorted(made) or len(singles) != 256 or max(singles) >= min(made, default=1 << 31):
        raise ValueError("ids do not follow the order of the merges")
    return ranks


def merger(ranks: dict[bytes, int], special: dict[str, int], pattern: str = PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def prove(path: str) -> Shortcut:
    """Run both proofs for a tokenizer file of byte-level BPE, once for each driver."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    spec = json.loads(definition)
    cutter = spec.get("pre_tokenizer") or {}
    plain = spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and cutter.get("type") == "ByteLevel"
    if not plain or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError("the shortcut is proved for byte-level BPE without a normalizer or prefix space only")
    tok = Tokenizer.from_str(definition)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that take white space along are not supported")
    whole = {t: i for t, i in _whole_tokens(tok, spec["model"]["vocab"]).items() if t not in special}
    ranks = _proved_ranks(tok, spec["model"]["vocab"], spec["model"]["merges"], special)
    odd_whole = _odd_for_merger(tok, ranks, special)
    return Shortcut(definition, whole, special, _odd_code_points(tok, regex.compile(PATTERN)), odd_whole, ranks)


class Encoder:
    """Ids of whole texts, equal to the library's default without added begin or end tokens."""

    def __init__(self, shortcut: Shortcut, kind: str = "<u4"):
        self.kind = np.dtype(kind)
        self.tok = Tokenizer.from_str(shortcut.definition)
        self.whole = {t: np.array([i], self.kind).tobytes() for t, i in shortcut.whole.items()}
        self.known = dict(self.whole)
        self.cut = regex.compile(PATTERN).findall
        self.special = {t: np.array([i], self.kind).tobytes() for t, i in shortcut.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(shortcut.special, key=len, reverse=True))) + ")").split if shortcut.special else None
        self.odd = _any_of(shortcut.odd)
        self.merge = merger(shortcut.ranks, shortcut.special)._encode_single_piece

    def _merge(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > MOST_KNOWN:
            self.known = dict(self.whole)
        width = self.kind.itemsize
        for p in pieces:
            if p not in self.known:
                self.known[p] = b"".join([i.to_bytes(width, "little") for i in self.merge(p)])

    def _run(self, text: str) -> bytes:
        cuts = self.cut(text)
        try:
            return b"".join(map(self.known.__getitem__, cuts))
        except KeyError:
            missing = set(cuts).difference(self.known)
            if len(missing) > MOST_KNOWN // 2:  # a text with more rare pre-tokens than are remembered
                return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
            self._merge(missing)
            if len(self.known) < len(missing) + len(self.whole) + 1:  # the store was emptied
                self._merge(set(cuts))
            return b"".join(map(self.known.__getitem__, cuts))

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned integers of ``kind``."""
        if not text:
            return b""
        if self.odd(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self.split is None or not any(s in text for s in self.special):
            return self._run(text)
        return b"".join(self.special[p] if p in self.special else self._run(p) for p in self.split(text) if p)

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // self.kind.itemsize


class WholeEncoder:
    """The same ids where all of them are wanted: the merger runs over whole texts.

    Texts in which no two signs of white space meet are cut by the plain pattern.
    """

    def __init__(self, shortcut: Shortcut, kind: str = "<u4"):
        self.kind = np.dtype(kind)
        self.tok = Tokenizer.from_str(shortcut.definition)
        self.merger = merger(shortcut.ranks, shortcut.special)
        self.plain = merger(shortcut.ranks, shortcut.special, PLAIN_PATTERN)
        self.special = set(shortcut.special)
        self.odd = _any_of(shortcut.odd_whole)
        self.strange = _any_of([*shortcut.odd_whole, *FAR_SPACES])

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.kind)
        far = self.strange(text)
        if far and self.odd(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)
        if far or any(s in text for s in self.special) or b"  " in text.encode("utf-8", "surrogatepass").translate(SPACES):
            return self.merger.encode_to_numpy(text, allowed_special=self.special).astype(self.kind)
        return self.plain.encode_to_numpy(text, allowed_special=self.special).astype(self.kind)


_ENCODERS: dict[tuple, tuple[Shortcut, Encoder]] = {}


def worker_encoder(shared, kind: str, make=Encoder):
    """The encoder of this Python worker, made once from a broadcast ``Shortcut``."""
    key = (kind, make)
    if key not in _ENCODERS or _ENCODERS[key][0] is not shared.value:
        _ENCODERS[key] = (shared.value, make(shared.value, kind))
    return _ENCODERS[key][1]


def share(spark: SparkSession, path: str):
    """Broadcast a proved tokenizer: as large as its file (a few MB), whatever the corpus."""
    bound_batches(spark)
    return spark.sparkContext.broadcast(prove(path))


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    shared = share(spark, path)

    @pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(shared, "<u2" if max(shared.value.whole.values(), default=0) < 65_000 else "<u4")
        for part in parts:
            yield pd.Series([encoder.count(t) for t in part], dtype="int64")

    return run(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, whole texts.

    A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat are counted each; no
    rows give no rows. Special strings inside texts count as the library's default has it.
    """
    slim = pick(docs, doc_id=id_col, text=text_col)
    n = token_count(docs.sparkSession, F.col("text"), path)
    counted = slim.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
