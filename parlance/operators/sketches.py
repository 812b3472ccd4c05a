"""Count-Min sketches of n-grams, partial statistics of shards, and their merging.

A sketch is a table: for each order and each of ``depth`` rows the counts of ``width`` slots. Sketches
of the same size are merged by adding them up, and a token's estimate is its smallest slot.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.keywords import grams, token_lists, token_order

DEPTH, WIDTH = 4, 262_144
TOP_OF_SHARD = {1: 1500, 2: 1500, 3: 1000}


def _slot(token: str, row: Column, width: int) -> Column:
    """Slot of a token in a row: 32 bits of MD5, which other engines have as well."""
    return (F.conv(F.substring(F.md5(F.concat(row.cast("string"), F.lit(":"), F.col(token))), 1, 8), 16, 10).cast("long") % width).cast("int")


def count_min(counts: DataFrame, depth: int = DEPTH, width: int = WIDTH, by: tuple[str, ...] = ()) -> DataFrame:
    """``n, row, slot, c`` (and ``by``) of ``counts(n, token, freq)``: at most depth * width rows an order."""
    rows = counts.select(*by, "n", "token", "freq", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    return rows.groupBy(*by, "n", "row", _slot("token", F.col("row"), width).alias("slot")).agg(F.sum("freq").alias("c"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The sum of all sketches of one size."""
    return sketches.groupBy("n", "row", "slot").agg(F.sum("c").alias("c"))


def estimate(names: DataFrame, sketch: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """``n, token, estimate`` of ``names(n, token)``: never under the true count; 0 for a token that was not seen."""
    asked = names.select("n", "token", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")).withColumn("slot", _slot("token", F.col("row"), width))
    met = asked.join(sketch.select("n", "row", "slot", "c"), ["n", "row", "slot"], "left")
    return met.groupBy("n", "token").agg(F.min(F.coalesce("c", F.lit(0))).alias("estimate"))


def stream_grams(messages: DataFrame, shard: str = "shard", mask=None) -> DataFrame:
    """``shard, n, token`` of n-grams that run on from one message of a shard into the next, in order of ``conv_id, msg_seq``.

    A message is followed by the first two tokens after it, so each shard is one stream of tokens.
    """
    lists = token_lists(messages, mask, (shard,)).where(F.size("words") > 0)
    order = Window.partitionBy(shard).orderBy("conv_id", "msg_seq")
    after = F.concat(F.slice(F.coalesce(F.lead("words").over(order), F.array().cast("array<string>")), 1, 2), F.slice(F.coalesce(F.lead("words", 2).over(order), F.array().cast("array<string>")), 1, 1))
    rows = lists.withColumn("after", after).select(F.col(shard).alias("shard"), F.size("words").alias("own"), F.explode(F.array(F.concat("words", F.slice("after", 1, 2)))).alias("words"))
    return grams(rows, keep=("shard", "own")).where(F.col("start") < F.col("own")).select("shard", "n", "token")


def partials(messages: DataFrame, shard: str = "shard", top: Mapping[int, int] = TOP_OF_SHARD, depth: int = DEPTH, width: int = WIDTH, mask=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a shard knows by itself: ``tops(shard, n, token, count_est)``, ``sketches(shard, n, row, slot, c)`` and ``totals(shard, total)``."""
    counts = stream_grams(messages, shard, mask).groupBy("shard", "n", "token").agg(F.count("*").alias("freq"))
    best = Window.partitionBy("shard", "n").orderBy(F.desc("freq"), *token_order("token"))
    limit = F.create_map(*[F.lit(x) for pair in top.items() for x in pair])
    ranked = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= max(top.values()))
    tops = ranked.where(F.col("place") <= F.element_at(limit, F.col("n"))).select("shard", "n", "token", F.col("freq").alias("count_est"))
    totals = counts.where("n = 1").groupBy("shard").agg(F.sum("freq").alias("total"))
    return tops, count_min(counts, depth, width, ("shard",)), totals


def merge_partials(tops: DataFrame, limits: Mapping[int, int], sketches: DataFrame | None = None, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """``n, token, freq, upper, ord``: candidates of all shards by upper bound, then by summed estimate, ties collated.

    The upper bound is the merged sketch's estimate; without sketches, or where it is 0, the
    summed estimate. Tokens are trimmed and empty ones left out; rows of the older form
    without an order count as single words. A limit of 0 or less is none.
    """
    order = F.coalesce("n", F.lit(1)) if "n" in tops.columns else F.lit(1)
    sums = tops.select(order.alias("n"), F.trim("token").alias("token"), F.coalesce("count_est", F.lit(0)).alias("c")).where("token <> ''")
    sums = sums.groupBy("n", "token").agg(F.sum("c").alias("freq"))
    if sketches is not None:
        found = estimate(sums.select("n", "token"), merge_sketches(sketches), depth, width)
        sums = sums.join(found, ["n", "token"]).withColumn("upper", F.coalesce(F.nullif("estimate", F.lit(0)), "freq")).drop("estimate")
    else:
        sums = sums.withColumn("upper", F.col("freq"))
    place = Window.partitionBy("n").orderBy(F.desc("upper"), F.desc("freq"), *token_order("token"))
    limit = F.create_map(*[F.lit(x) for n, k in limits.items() for x in (n, k if k > 0 else (1 << 31) - 1)])
    return sums.withColumn("ord", F.row_number().over(place)).where(F.col("ord") <= F.element_at(limit, F.col("n")))
