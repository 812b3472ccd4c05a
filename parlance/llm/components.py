"""Connected components by alternating large-star and small-star rounds.

The published two-step star contraction (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every round is one aggregation and one equi-join, edges
stay distributed, and each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import discard, materialize


#: A key counts as hot from this many (small) rows on, or from a thousandth of all rows if that is more.
HOT_ROWS = 100_000


def join_hot(rows: DataFrame, found: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` joined with ``found``, one row a key with ``n``, the rows of that key among ``rows``, which has no ``n``.

    A key of over a thousandth of the ``total`` rows would fill one task. There are at most a
    thousand such keys, which are broadcast; all others meet in an ordinary join.
    """
    key = [key] if isinstance(key, str) else key
    most = max(HOT_ROWS, total // 1000)
    hot = found.where(F.col("n") > most)
    if total <= most:
        return rows.join(found, key)
    cool = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(found.where(F.col("n") <= most), key)
    return cool.unionByName(rows.join(F.broadcast(hot), key))


def _with_min(edges: DataFrame, total: int) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_hot(edges, low, "u", total).drop("n")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_min(both, 2 * total).withColumn("m", F.least("m", "u"))
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_min(down, total)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = near.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` to ``(node long, root long)``, root the smallest node reachable.

    Self loops and repeated edges are allowed; nodes without an edge do not appear.
    No edges give no rows. ``max_rounds`` only guards against an endless loop: when it
    is reached an error is raised, never a partial answer.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "cc")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        step = materialize(_small_star(_large_star(now, seen[0]), seen[0]), "cc")
        digest = _digest(step)
        discard(now)
        now = step
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError("connected components did not settle")
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(heads)
