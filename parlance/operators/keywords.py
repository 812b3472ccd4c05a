"""Keywords and phrases: n-gram counts, neighbours, candidates, scores."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions.text import mask_text, ngrams, tokens

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def token_lists(messages: DataFrame, mask=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``conv_id, msg_seq, words`` (and ``keep``): explode() keeps the list as a column, so it is made once."""
    made = tokens(mask_text(F.col("content"), mask))
    return messages.select(*keep, "conv_id", "msg_seq", F.explode(F.array(made)).alias("words"))


def token_total(lists: DataFrame) -> DataFrame:
    """One row with the number of all tokens."""
    return lists.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("total"))


def grams(lists: DataFrame, orders: tuple[int, ...] = (1, 2, 3), keep: tuple[str, ...] = ()) -> DataFrame:
    """``n, token, lhs, rhs, start`` (and ``keep``) of all n-grams inside the lists."""
    every = F.concat(*[ngrams(F.col("words"), n) for n in orders])
    return lists.select(*keep, F.explode(every).alias("g")).select(*keep, "g.*")


def gram_counts(all_grams: DataFrame) -> DataFrame:
    return all_grams.groupBy("n", "token").agg(F.count("*").alias("freq"))


@dataclass(frozen=True)
class Scoring:
    """What scores are made of: weights of PMI and entropy, factors of three words and of one, least frequency and PMI of a phrase."""

    alpha: float = L.ALPHA
    beta: float = L.BETA
    gamma: float = L.GAMMA
    delta: float = L.DELTA
    min_freq: float = L.MIN_FREQ
    min_pmi: float = L.MIN_PMI


def order_limits(every: int = L.TOP_PER_ORDER, own: Mapping[int, int] | None = None) -> dict[int, int]:
    """Limits of the three orders: ``every`` (0 or less: none) where ``own`` gives no positive one."""
    own = own or {}
    return {n: own[n] if own.get(n, 0) > 0 else every for n in (1, 2, 3)}


def token_order(token: Column | str) -> list[Column]:
    """Order of equal counts and scores: Unicode collation, then code points."""
    token = F.col(token) if isinstance(token, str) else token
    return [F.collate(token, "UNICODE"), token]


def heavy_hitters(counts: DataFrame, limits: Mapping[int, int]) -> DataFrame:
    """The most frequent n-grams of each order, exact, ties collated; a limit of 0 or less is none.

    Each task keeps its own best before the exchange, so what is ranked at the end does not grow with
    the vocabulary; Spark does so only for a literal bound under a threshold, which is raised here.
    """
    most, conf = max(limits.values(), default=0), counts.sparkSession.conf
    if int(conf.get(GROUP_LIMIT)) < most + 1:
        conf.set(GROUP_LIMIT, str(most + 1))
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("freq"), *token_order("token")))
    best = counts.where(F.col("n").isin(*limits)).withColumn("ord", rank)
    if min(limits.values(), default=1) <= 0:
        most = 1 << 31
    limit = F.create_map(*[F.lit(x) for n, k in limits.items() for x in (n, k if k > 0 else (1 << 31) - 1)])
    best = best.where(F.col("ord") <= most) if most < 1 << 31 else best
    return best.where(F.col("ord") <= F.element_at(limit, F.col("n")))


def with_support(base: DataFrame) -> DataFrame:
    """``n, token`` of candidates and of all their parts."""
    parts = F.split("token", " ")
    own = F.struct(F.col("n").alias("n"), F.col("token").alias("token"))
    part = lambda n, a, k: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(parts, a, k), " ").alias("token"))
    closed = (
        F.when(F.col("n") == 1, F.array(own))
        .when(F.col("n") == 2, F.array(own, part(1, 1, 1), part(1, 2, 1)))
        .otherwise(F.array(own, part(1, 1, 1), part(1, 2, 1), part(1, 3, 1), part(2, 1, 2), part(2, 2, 2)))
    )
    return base.select(F.explode(closed).alias("c")).select("c.*").distinct()


def _parts(token: str) -> dict[int, list[str]]:
    """The shorter n-grams inside a phrase, by length."""
    words = token.split()
    return {1: words if len(words) > 1 else [], 2: [" ".join(words[:2]), " ".join(words[1:3])] if len(words) >= 3 else []}


def bundle_union(ordered: Mapping[int, list[str]], most: int) -> list[tuple[int, str, bool, int]]:
    """``(n, token, is_base, ord)`` of at most ``most`` candidates from the ordered ones of each length.

    Parts of longer phrases stand behind the candidates of their length and are tried as such.
    Phrases of three words enter first, then two, then single words, each with its parts or not
    at all; what does not fit is passed over. A token is a base one once its own bundle has
    entered. Base tokens come first, in order of entry, then parts in theirs.
    """
    lists = {n: dict.fromkeys(ordered.get(n, [])) for n in (1, 2, 3)}
    for n in (2, 3):
        for token in list(lists[n]):
            for k, under in _parts(token).items():
                if k < n:
                    lists[k].update(dict.fromkeys(under))
    taken: dict[str, int] = {}
    base: dict[str, None] = {}
    for n in (3, 2, 1):
        for token in lists[n]:
            if len(taken) >= most:
                break
            bundle = {p: k for k, under in _parts(token).items() if k < n for p in under} | {token: n}
            if len(taken.keys() | bundle.keys()) <= most:
                for p, k in bundle.items():
                    taken.setdefault(p, k)
                base.setdefault(token)
    out = []
    for n in (1, 2, 3):
        own = [t for t in base if taken[t] == n] + [t for t, k in taken.items() if k == n and t not in base]
        out += [(n, t, t in base, i) for i, t in enumerate(own, start=1)]
    return out


def capped_union(hits: DataFrame, most: int = L.MOST_CANDIDATES) -> DataFrame:
    """``n, token, is_base, ord`` of at most ``most`` candidates of ``hits(n, token, ord)``.

    ``hits`` is bounded by the limits of the orders, so the driver fills the union.
    """
    ordered: dict[int, list[str]] = {1: [], 2: [], 3: []}
    for r in hits.orderBy("n", "ord").select("n", "token").toLocalIterator():
        ordered[r["n"]].append(r["token"])
    return _named(hits.sparkSession, bundle_union(ordered, most))


def _named(spark: SparkSession, rows: list[tuple[int, str, bool, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "n int, token string, is_base boolean, ord int")


def neighbour_stats(all_grams: DataFrame) -> DataFrame:
    """``n, token, freq, left_entropy, right_entropy`` (bits) of the n-grams, from one grouping by neighbour."""
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("lhs").alias("nb")), F.struct(F.lit("r").alias("side"), F.col("rhs").alias("nb"))))
    counts = all_grams.select("n", "token", sides.alias("s")).groupBy("n", "token", "s.side", "s.nb").agg(F.count("*").alias("c"))
    # Entropy from sums alone: log2 T - sum(c log2 c) / T.
    one = lambda s: F.col("side") == s
    log = F.col("c") * F.log2(F.col("c").cast("double"))
    sums = counts.groupBy("n", "token").agg(
        F.sum(F.when(one("l"), F.col("c"))).alias("freq"), F.sum(F.when(one("l"), log)).alias("hl"), F.sum(F.when(one("r"), log)).alias("hr")
    )
    bits = lambda h: F.log2(F.col("freq").cast("double")) - F.col(h) / F.col("freq")
    return sums.select("n", "token", "freq", bits("hl").alias("left_entropy"), bits("hr").alias("right_entropy"))


def neighbour_entropy(all_grams: DataFrame) -> DataFrame:
    """``n, token, left_entropy, right_entropy`` in bits."""
    return neighbour_stats(all_grams).drop("freq")


def _pmi(joint, a, b, total):
    return F.when((joint > 0) & (a > 0) & (b > 0) & (total > 0), F.log2(joint * total / (a * b))).otherwise(0.0)


def bigram_pmi(counts: DataFrame, total: DataFrame) -> DataFrame:
    """``token, freq, pmi`` of the two-word n-grams of ``counts(n, token, freq)``; 0 where a part does not occur."""
    one = lambda name: counts.where("n = 1").select(F.col("token").alias(name), F.col("freq").cast("double").alias(f"f_{name}"))
    pairs = counts.where("n = 2").withColumns({"a": F.get(F.split("token", " "), F.lit(0)), "b": F.get(F.split("token", " "), F.lit(1))})
    rows = pairs.join(one("a"), "a", "left").join(one("b"), "b", "left").fillna(0.0, ["f_a", "f_b"]).crossJoin(F.broadcast(total))  # one row
    pmi = _pmi(F.col("freq").cast("double"), F.col("f_a"), F.col("f_b"), F.col("total").cast("double"))
    return rows.select("token", "freq", F.round(pmi, 6).alias("pmi"))


def score(stats: DataFrame, total: int, how: Scoring = Scoring()) -> DataFrame:
    """``token, n, freq, pmi, left_entropy, right_entropy, min_entropy, score``.

    ``stats(n, token, freq, left_entropy, right_entropy)`` are the candidates with their parts,
    as many as the cap allows, and ``total`` the number of all tokens. Phrases that pass lower the
    scores of their parts.
    """
    parts = F.split("token", " ")
    p = lambda i: F.get(parts, F.lit(i))
    pair = lambda i: F.concat_ws(" ", p(i), p(i + 1))
    freq = lambda name: F.broadcast(stats.select(F.col("token").alias(name), F.col("freq").cast("double").alias(f"f_{name}")))
    rows = stats.withColumns({"a": p(0), "b": F.when(F.col("n") > 1, p(1)), "c": p(2), "ab": F.when(F.col("n") == 3, pair(0)), "bc": F.when(F.col("n") == 3, pair(1))})
    for name in ("a", "b", "c", "ab", "bc"):
        rows = rows.join(freq(name), name, "left").fillna(0.0, [f"f_{name}"])
    f, t = F.col("freq").cast("double"), F.lit(float(total))
    x, y = _pmi(F.col("f_ab"), F.col("f_a"), F.col("f_b"), t), _pmi(F.col("f_bc"), F.col("f_b"), F.col("f_c"), t)
    positive = F.when((x > 0) & (y > 0), (x + y) / 2).when(x > 0, x).when(y > 0, y)
    product = F.col("f_a") * F.col("f_b") * F.col("f_c")
    three = F.coalesce(positive, F.when((product > 0) & (t > 0), F.log2(f * t / product)).otherwise(0.0))
    often = F.col("freq") >= how.min_freq
    pmi = F.when((F.col("n") == 2) & often, _pmi(f, F.col("f_a"), F.col("f_b"), t)).when((F.col("n") == 3) & often, three).otherwise(0.0)
    side = lambda s: F.when((F.col("n") > 1) & often, F.coalesce(f"{s}_entropy", F.lit(0.0))).otherwise(0.0).alias(f"{s}_entropy")
    rows = rows.select("n", "token", "freq", "a", "b", "c", "ab", "bc", pmi.alias("pmi"), side("left"), side("right"))
    rows = rows.withColumn("min_entropy", F.least("left_entropy", "right_entropy"))
    passed = (F.col("n") > 1) & often & (F.col("pmi") >= how.min_pmi)
    known = F.forall(F.split("token", " "), lambda w: w.isin(*L.WHITELIST))
    raw = f * (1 + how.alpha * F.col("pmi")) * (1 + how.beta * F.col("min_entropy"))
    raw = raw * F.when(F.col("n") == 3, how.gamma).otherwise(1.0) * F.when(known, L.WHITELIST_BONUS).otherwise(1.0)
    rows = rows.withColumn("raw", F.when(F.col("n") == 1, f * how.delta).when(passed, raw).otherwise(0.0)).withColumn("passed", passed)
    hit = lambda c, w: F.struct(F.col(c).alias("token"), F.log(F.lit(w)).alias("w"))
    two = F.array(hit("a", L.UNI_OF_BI), hit("b", L.UNI_OF_BI))
    tri = F.array(*[hit(c, L.UNI_OF_TRI) for c in ("a", "b", "c")], *[hit(c, L.BI_OF_TRI) for c in ("ab", "bc")])
    # Scores of single words often lie right between two sixth digits, where the order of a sum and the way of rounding show: the
    # logarithms are added in ascending order, whatever the order of the rows, and scores are scaled and then rounded, as in the SQL.
    total_w = F.aggregate(F.array_sort(F.collect_list("h.w")), F.lit(0.0), lambda s, w: s + w)  # as many as the candidates have parts, at most
    lowered = rows.where("passed").select(F.explode(F.when(F.col("n") == 2, two).otherwise(tri)).alias("h")).groupBy("h.token").agg(F.exp(total_w).alias("factor"))
    done = rows.join(F.broadcast(lowered), "token", "left")
    scaled = F.col("raw") * F.coalesce("factor", F.lit(1.0)) * 1e6
    return done.select(
        "token", "n", "freq", F.round("pmi", 6).alias("pmi"), F.round("left_entropy", 6).alias("left_entropy"), F.round("right_entropy", 6).alias("right_entropy"),
        F.round("min_entropy", 6).alias("min_entropy"), (F.round(scaled) / 1e6).alias("score"),
    )


def keyword_scores(
    messages: DataFrame, limits: Mapping[int, int] | int = L.TOP_PER_ORDER, mask=None, how: Scoring = Scoring(), most: int = L.MOST_CANDIDATES
) -> DataFrame:
    """Scores of the candidates of ``messages`` (already filtered to the window).

    Two passes over the messages: the first counts n-grams and finds the candidates, a bounded
    list that the driver caps with ``bundle_union``; the second recounts these with their neighbours.
    """
    limits = order_limits(limits) if isinstance(limits, int) else order_limits(own=limits)
    every = grams(token_lists(messages, mask))
    counts = gram_counts(every)
    hits = heavy_hitters(counts, limits).select("n", "token", "ord", F.lit(0).cast("long").alias("total"))
    tokens = counts.where("n = 1").agg(F.coalesce(F.sum("freq"), F.lit(0)).cast("long").alias("total"))
    ordered: dict[int, list[str]] = {1: [], 2: [], 3: []}
    total = 0
    for r in hits.unionByName(tokens.select(F.lit(0).alias("n"), F.lit("").alias("token"), F.lit(0).alias("ord"), "total")).orderBy("n", "ord").toLocalIterator():
        total += r["total"]
        if r["n"]:
            ordered[r["n"]].append(r["token"])
    names = _named(messages.sparkSession, bundle_union(ordered, most)).select("n", "token")
    stats = neighbour_stats(every.join(F.broadcast(names), ["n", "token"], "left_semi"))  # at most ``most`` names
    return score(stats, total, how)
