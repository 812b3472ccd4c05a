"""Top views and their reconciliation with the last shown ones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.lexicon import TOP_VIEW
from parlance.operators.keywords import token_order


def top_views(scored: DataFrame, limit: float = TOP_VIEW) -> DataFrame:
    """``view, rank, token, n, freq, score``: the best phrases, filled up with words, and the best words."""
    most = math.floor(limit) if limit and math.isfinite(limit) and limit >= 1 else TOP_VIEW
    usable = scored.where((F.col("freq") > 0) & ((F.col("score") > 0) | (F.col("n") == 1)))
    kind = F.when(F.col("n") > 1, "phrases").otherwise("words")
    place = Window.partitionBy("kind").orderBy(F.desc("score"), F.desc("freq"), "n", *token_order("token"))
    best = usable.withColumn("kind", kind).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
    whole = Window.partitionBy()  # at most 2 * most rows
    best = best.withColumn("moved", (F.col("rank") + F.sum((F.col("kind") == "phrases").cast("int")).over(whole)).cast("int"))
    slot = lambda view, rank: F.struct(F.lit(view).alias("view"), F.col(rank).alias("rank"))
    filled = F.when(F.col("kind") == "phrases", F.array(slot("phrases", "rank"))).when(F.col("moved") <= most, F.array(slot("words", "rank"), slot("phrases", "moved")))
    shown = best.withColumn("s", F.explode(filled.otherwise(F.array(slot("words", "rank")))))
    return shown.select("s.view", "s.rank", "token", "n", "freq", "score")


def reconcile(previous: DataFrame, following: DataFrame, max_swaps: float = 1) -> DataFrame:
    """For each view, keep the previous order if only the order changed, by more than one swap of neighbours.

    With ``max_swaps`` under 1 one swap of neighbours is a change as well.

    Both have ``view, rank, token, n, freq, score``. Other tokens, scores off by more than 1e-6 or
    other frequencies give the following view.
    """
    item = F.struct("rank", "token", "freq", "score")
    gather = lambda df, name: df.groupBy("view").agg(F.array_sort(F.collect_list(item)).alias(name))
    both = gather(following, "nxt").join(gather(previous, "prv"), "view", "left")
    names = lambda c: F.transform(c, lambda x: x.token)
    same = F.array_sort(names("nxt")) == F.array_sort(names("prv"))
    moved = F.filter(F.transform(F.zip_with(names("nxt"), names("prv"), lambda a, b: a == b), lambda ok, i: F.when(ok, -1).otherwise(i)), lambda i: i >= 0)
    adjacent = (F.size(moved) == 2) & (F.get(moved, F.lit(1)) == F.get(moved, F.lit(0)) + 1)
    close = (F.size(moved) == 0) | adjacent if math.floor(max(0, max_swaps)) else F.size(moved) == 0
    pairs = F.arrays_zip(F.array_sort(F.transform("nxt", lambda x: F.struct(x.token.alias("token"), x.freq.alias("freq"), x.score.alias("score")))).alias("a"), F.array_sort(F.transform("prv", lambda x: F.struct(x.token.alias("token"), x.freq.alias("freq"), x.score.alias("score")))).alias("b"))
    steady = F.forall(pairs, lambda z: (z.a.freq == z.b.freq) & (F.abs(z.a.score - z.b.score) <= 1e-6))
    keep = both.select("view", F.coalesce(same & ~close & steady, F.lit(False)).alias("keep"))
    old = previous.join(F.broadcast(keep.where("keep")), "view", "left_semi")
    new = following.join(F.broadcast(keep.where("not keep")), "view", "left_semi")
    return old.unionByName(new)


def save_views(views: DataFrame, path: str) -> int:
    """Keep ``views`` as the last shown ones: a new version in ``path``, whose number is returned."""
    spark = views.sparkSession
    last = max(_versions(spark, path), default=0)
    views.write.mode("overwrite").parquet(f"{path}/version={last + 1}")
    return last + 1


def load_views(spark: SparkSession, path: str) -> DataFrame | None:
    """The last shown views of ``path``; none before the first run."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={max(found)}") if found else None


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "version=*/_SUCCESS")) if files.exists(folder) else []
    return [int(f.getPath().getParent().getName().partition("=")[2]) for f in done]


def show(following: DataFrame, path: str, max_swaps: float = 1) -> DataFrame:
    """The views to show: ``following``, reconciled with the last shown ones of ``path`` and kept there."""
    previous = load_views(following.sparkSession, path)
    shown = following if previous is None else reconcile(previous, following, max_swaps)
    save_views(shown, path)
    return load_views(following.sparkSession, path)
