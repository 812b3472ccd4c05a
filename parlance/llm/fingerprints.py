"""Document fingerprints by consistent weighted sampling, with built-in functions only.

Ioffe, "Improved Consistent Sampling, Weighted Minhash and L1 Sketching" (2010): for each
slot a term of weight w draws r and c from Gamma(2, 1) and b from the unit interval, all from
the term's hash; with t = floor(ln w / r + b) its value is ln c - r (t - b + 1). The slot keeps
(term, t) of the smallest value. Two texts agree in a slot with a probability equal to their
generalised Jaccard similarity, sum of minima over sum of maxima of the weights. Terms are
lower-cased words, weights their counts.

Logarithms cost more than all the rest, so the gamma draws come from counts of bits and Padé
fractions, and ln c from square roots and one more fraction; errors are under 0.002 of a draw.
A text and its edited form share the draws of a term, and its sample where its weights are equal.
Slots are drawn in chunks, a row each, so that the generated code stays small enough to be compiled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import materialize, pick, row_key, shuffle_parts

SLOTS = 48
#: Slots of one row while they are drawn; with eight the generated method is too long for the JVM to compile.
CHUNK = 2
SPACE = " \t\n\x0b\f\r"


def _bits(x: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1))


def _terms(text: Column) -> Column:
    """Lower-cased words; a text without words has the empty word alone."""
    return F.split(F.btrim(F.lower(text), F.lit(SPACE)), f"[{SPACE}]+")


def _gamma(x: Column) -> Column:
    """Gamma(2, 1) as -ln(v w), v and w uniform in (0, 1), from the 64 bits of x.

    v and w are 2^-n (1 + u) each. The sum of their two n is the place of the second set bit
    among 24; of (1 + u)(1 + u'), between 1 and 4, a Padé fraction around 2 gives the logarithm.
    """
    places = _bits(x, 0, 24).bitwiseOR(F.lit(3 << 24))
    second = places.bitwiseAND(places - 1)
    n = F.bit_count(second.bitwiseXOR(second - 1))
    q = (_bits(x, 24, 20).cast("double") * 2.0**-20 + 1.0) * (_bits(x, 44, 20).cast("double") * 2.0**-21 + 0.5)
    return (n - 1) * math.log(2) - (q * q - 1.0) * 3.0 / (q * (q + 4.0) + 1.0)


def _log_by_roots(x: Column) -> Column:
    """16 ln of the 16th root of x, by a Padé fraction around 1."""
    y = F.sqrt(F.sqrt(F.sqrt(F.sqrt(x))))
    return (y * y - 1.0) * 48.0 / (y * (y + 4.0) + 1.0)


def _draws(term: str, chunk: Column, slots: int) -> list[Column]:
    """For each slot of a chunk the columns r, ln c and b of a term's hash column."""
    out = []
    for k in range(slots):
        x, y, z = (F.xxhash64(F.col(term), chunk * (3 * slots) + (3 * k + i)) for i in range(3))
        out += [
            _gamma(x).alias(f"r{k}"),
            _log_by_roots(_gamma(y)).alias(f"c{k}"),
            (_bits(z, 20, 40).cast("double") * 2.0**-40).alias(f"b{k}"),
        ]
    return out


def _sample(k: int, log_weight: Column, term: Column) -> Column:
    """Value and sample of slot k in one long: 32 bits of the value, 31 bits that name (term, t)."""
    r, c, b = F.col(f"r{k}"), F.col(f"c{k}"), F.col(f"b{k}")
    t = (log_weight / r + b).cast("long")  # not negative, so this is the floor
    value = c - r * (t.cast("double") - b + 1.0)  # r is at most 18, ln c at least -8: far inside +-128
    rank = (value + 128.0) * float(1 << 24)
    name = F.shiftrightunsigned(term, 33).bitwiseXOR(F.shiftleft(t.bitwiseAND(F.lit(0xFFFF)), 15))
    return F.shiftleft(rank.cast("long"), 31).bitwiseOR(name)


def signatures(weights: DataFrame, keys: list[str], slots: int = SLOTS, chunk: int = CHUNK) -> DataFrame:
    """Signatures of two weightings of the same groups.

    ``weights`` has rows of a group (``keys``), a ``term`` (a 64-bit hash), its weight ``w`` and
    whether it holds in the first (``i``) and the second (``j``) text; a term has one row, or one
    for each text if its weights differ. Rows of a ``kind`` over 0 are no terms: their ``term`` is
    handed on as ``note1`` to ``note4``. Returns the keys, ``first_sig`` and ``second_sig``, arrays
    of ``slots`` 16-bit integers, null for a text without terms, and the notes.
    """
    if slots % chunk:
        raise ValueError("slots must fill whole chunks")
    notes = [f"note{k}" for k in range(1, 5)]
    rows = weights.select(*keys, "term", "kind", "i", "j", F.log(F.col("w").cast("double")).alias("log_weight"), F.explode(F.sequence(F.lit(0), F.lit(slots // chunk - 1))).alias("chunk"))
    drawn = rows.select(*keys, "chunk", "term", "kind", "i", "j", "log_weight", *_draws("term", F.col("chunk"), chunk))
    drawn = drawn.select(*keys, "chunk", "kind", "term", "i", "j", *[_sample(k, F.col("log_weight"), F.col("term")).alias(f"slot{k}") for k in range(chunk)])
    best = [F.min(F.when(F.col(side), F.col(f"slot{k}"))).alias(f"{side}{k}") for side in "ij" for k in range(chunk)]
    low = drawn.groupBy(*keys, "chunk").agg(*best, *[F.max(F.when(F.col("kind") == k, F.col("term"))).alias(c) for k, c in enumerate(notes, start=1)])
    slot = lambda x: F.xxhash64(x.bitwiseAND(F.lit((1 << 31) - 1))).bitwiseAND(F.lit(0xFFFF)).cast("int")
    part = lambda side: F.when(F.col(f"{side}0").isNotNull(), F.array(*[slot(F.col(f"{side}{k}")) for k in range(chunk)])).alias(side)
    parts = low.select(*keys, "chunk", part("i"), part("j"), *notes).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "i", "j"))).alias("parts"), *[F.max(c).alias(c) for c in notes])
    whole = lambda side: F.flatten(F.transform("parts", lambda x: x[side]))
    return parts.select(*keys, whole("i").alias("first_sig"), whole("j").alias("second_sig"), *notes)


def word_weights(rows: DataFrame, keys: list[str], first: str, second: str, notes: list[Column]) -> DataFrame:
    """``keys, term, kind, w, i, j`` of the texts ``first`` and ``second`` and of up to four ``notes``, as ``signatures`` takes them."""
    entry = lambda side, body, more: F.struct(F.lit(side).alias("side"), body.alias("body"), more.alias("notes"))
    none = F.array().cast("array<bigint>")
    cases = F.array(entry(0, F.col(first), none), entry(1, F.col(second), none), entry(2, F.lit(None).cast("string"), F.array(*notes)))
    both = rows.select(*keys, F.explode(cases).alias("x")).select(*keys, "x.side", "x.body", "x.notes")
    # A row is one of a text's words, or one of the notes.
    items = F.when(F.col("side") < 2, _terms(F.col("body"))).otherwise(F.transform("notes", lambda x: x.cast("string")))
    found = both.select(*keys, "side", F.posexplode(items).alias("at", "item"))
    term = F.when(F.col("side") < 2, F.xxhash64("item")).otherwise(F.col("item").cast("long"))
    kind = F.when(F.col("side") < 2, 0).otherwise(F.col("at") + 1)
    one = lambda k: F.sum((F.col("side") == k).cast("int"))
    counts = found.select(*keys, term.alias("term"), kind.alias("kind"), "side").groupBy(*keys, "term", "kind").agg(one(0).alias("own"), one(1).alias("new"))
    weighted = lambda w, i, j: F.struct(w.cast("double").alias("w"), F.lit(i).alias("i"), F.lit(j).alias("j"))
    a, b = F.col("own"), F.col("new")
    split = F.when(F.col("kind") > 0, F.array(weighted(F.lit(1), False, False))).when(a == b, F.array(weighted(a, True, True))).when(b == 0, F.array(weighted(a, True, False)))
    split = split.when(a == 0, F.array(weighted(b, False, True))).otherwise(F.array(weighted(a, True, False), weighted(b, False, True)))
    return counts.select(*keys, "term", "kind", F.explode(split).alias("x")).select(*keys, "term", "kind", "x.w", "x.i", "x.j")


def as_hex(sig: Column) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of slots that agree: an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a).cast("double")


def _sha_words(text: Column) -> list[Column]:
    """SHA-256 as four longs, so that aggregation can carry it in fixed-width keys."""
    sha = F.sha2(text.cast("binary"), 256)
    part = lambda i: F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long")
    return [F.shiftleft(part(2 * i), 32).bitwiseOR(part(2 * i + 1)) for i in range(4)]


def _followers(slim: DataFrame) -> DataFrame:
    """``doc_id, rid, key, v, nrid, nkey, n, times``: for each different row, by name, the row after it.

    Rows are in order of id, null first, then text hash; after the last comes the first. Of rows
    that repeat all but the last are followed by themselves (``v`` 0). Only ids and hashes are
    sorted, in ranges; the driver sees the first row of each range.
    """
    spark = slim.sparkSession
    once = slim.groupBy("doc_id", "key", "rid", "n").agg(F.count("*").alias("c"))
    ranges = once.repartitionByRange(max(4, 4 * shuffle_parts(spark)), F.asc_nulls_first("doc_id"), "key")
    order = materialize(ranges.withColumn("part", F.spark_partition_id()), "id-order")
    first = order.groupBy("part").agg(F.min_by(F.struct("rid", "key"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "key")).alias("one")).orderBy("part").collect()
    after = [(r["part"], nxt["one"]["rid"], nxt["one"]["key"]) for r, nxt in zip(first, [*first[1:], *first[:1]], strict=True)]
    heads = spark.createDataFrame(after, "part int, hrid long, hkey long")  # one row a range
    place = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "key")
    led = order.withColumns({"nrid": F.lead("rid").over(place), "nkey": F.lead("key").over(place)}).join(F.broadcast(heads), "part")
    last = F.col("nrid").isNull()
    follower = lambda v, rid, key, times: F.struct(F.lit(v).alias("v"), rid.alias("nrid"), key.alias("nkey"), times.alias("times"))
    nxt = follower(1, F.when(last, F.col("hrid")).otherwise(F.col("nrid")), F.when(last, F.col("hkey")).otherwise(F.col("nkey")), F.lit(1).cast("long"))
    itself = follower(0, F.col("rid"), F.col("key"), F.col("c") - 1)
    both = led.select("doc_id", "rid", "key", "n", F.explode(F.when(F.col("c") > 1, F.array(nxt, itself)).otherwise(F.array(nxt))).alias("f"))
    return materialize(both.select("doc_id", "rid", "key", "n", "f.*"), "followers")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Fingerprint of each text and of its edited form, whose last quarter is the next document's beginning.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. Ids are of any type with an order. Documents follow each other by id, null ids
    first, equal ids by text hash; after the last comes the first. A null text counts as empty; an
    empty text has the fingerprint of the empty word. Rows that repeat follow each other. Very
    long texts are read whole. Other columns take no part, whatever their names. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    slim = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))
    slim = slim.withColumn("rid", row_key(F.col("doc_id"), F.lit(0)))
    follow = _followers(slim.select("doc_id", "key", "rid", F.char_length("text").cast("long").alias("n")))
    texts = slim.groupBy("rid", "key").agg(F.first("text").alias("text"))  # met twice below, exchanged once
    cut = F.floor(F.col("n") / 4).cast("int")
    lent = follow.join(texts.withColumnsRenamed({"rid": "nrid", "key": "nkey"}), ["nrid", "nkey"])
    lent = lent.select("rid", "key", "v", "n", F.substring(F.col("text"), F.lit(1), cut).alias("start"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n") - cut).cast("int")), "start")
    rows = texts.join(lent, ["rid", "key"]).select("rid", "key", "v", "text", F.explode(F.array(edited)).alias("edited"))
    keys = ["rid", "key", "v"]
    sigs = materialize(signatures(word_weights(rows, keys, "text", "edited", _sha_words(F.col("edited"))), keys, slots), "signatures")
    after = sigs.where("v = 1").select(F.col("rid").alias("nrid"), F.col("key").alias("nkey"), F.col("first_sig").alias("next_sig"))
    near = sigs.join(follow, keys).join(after, ["nrid", "nkey"])
    near = near.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"note{k}"), 16, "0") for k in range(1, 5)]))
    return near.select(
        "doc_id", F.col("n").alias("n_chars"), sha.alias("edited_sha256"), as_hex(F.col("first_sig")).alias("fingerprint"), as_hex(F.col("second_sig")).alias("edited_fingerprint"),
        likeness(F.col("first_sig"), F.col("second_sig")).alias("near_edited"), likeness(F.col("first_sig"), F.col("next_sig")).alias("near_next"),
    )
