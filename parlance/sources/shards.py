"""Shards of messages: Parquet by month, a catalogue with time bounds, pruning by cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.scalars import month_key

#: A shard is closed once its messages reach this many bytes.
SHARD_BYTES = 14 << 20
HOUR_MS = 3_600_000


def message_bytes(content: Column) -> Column:
    """UTF-8 bytes of a message and its line feed."""
    return (F.coalesce(F.octet_length(content), F.lit(0)) + 1).cast("long")


def deal(messages: DataFrame, shard_bytes: int = SHARD_BYTES, order: tuple[str, ...] = ("ts_ms", "conv_id", "msg_seq")) -> DataFrame:
    """``messages`` with ``month`` and ``shard``, the month's shard from 0 on, in ``order``; messages without a time are month 'none'.

    Each shard holds the messages that begin in its stretch of ``shard_bytes``, so it is at most one
    message larger. Hours are summed first, so no task has to walk through a month.
    """
    rows = messages.withColumn("month", F.coalesce(month_key(F.col("ts_ms")), F.lit("none")))
    rows = rows.withColumn("hour", F.coalesce(F.floor(F.col("ts_ms") / HOUR_MS), F.pmod(F.xxhash64(*order), F.lit(1024)))).withColumn("size", message_bytes(F.col("content")))
    hours = rows.groupBy("month", "hour").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("month").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("month", "hour", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("month", "hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("skip") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.join(hours, ["month", "hour"]).withColumn("shard", F.floor(before / shard_bytes).cast("int")).drop("hour", "size", "skip")


def write_shards(messages: DataFrame, path: str, mode: str = "append", shard_bytes: int = SHARD_BYTES) -> None:
    """``content, ts_ms, model, role`` by month and shard; rows without a time go to month 'none'. Files have time bounds in their footers."""
    rows = deal(messages, shard_bytes, ("ts_ms", "content")).select("content", "ts_ms", "model", "role", "month", "shard")
    rows.repartition("month", "shard").sortWithinPartitions("month", "shard", "ts_ms").write.mode(mode).partitionBy("month", "shard").parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a store; 0 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(files.getContentSummary(folder).getLength()) if files.exists(folder) else 0


def read_shards(spark: SparkSession, path: str, cutoff_ms: int | None = None) -> DataFrame:
    """All shards, or those that may hold messages from the cutoff on; months prune folders, times row groups."""
    rows = spark.read.option("basePath", path).parquet(path)
    if cutoff_ms is None:
        return rows
    first = month_key(F.lit(cutoff_ms))
    return rows.where((F.col("month") >= first) & (F.col("month") != "none") & (F.col("ts_ms") >= cutoff_ms))


def read_shard(spark: SparkSession, path: str, month: str, shard: int | None = None) -> DataFrame:
    """The messages of one month, or of one of its shards; other folders are not opened."""
    rows = read_shards(spark, path).where(F.col("month") == month)
    return rows if shard is None else rows.where(F.col("shard") == shard)


def legacy_messages(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Shards kept as one text: a message a line, without a time; all other columns stay."""
    line = F.explode(F.split(F.col(f"`{text_col}`"), "\n")).alias("content")
    rest = [F.col(f"`{c}`") for c in texts.columns if c not in (text_col, "content", "ts_ms")]
    return texts.select(*rest, line).withColumn("ts_ms", F.lit(None).cast("long"))


def clear_shards(spark: SparkSession, path: str) -> bool:
    """Delete all shards; whether there were any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shard_catalog(messages: DataFrame, *shard: str) -> DataFrame:
    """``shard, size, min_ts, max_ts, message_count``; the size counts UTF-8 bytes and one more a message.

    ``shard`` names the columns that tell shards apart (months by default).
    """
    return messages.groupBy(_name(shard).alias("shard")).agg(
        F.sum(message_bytes(F.col("content"))).alias("size"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count("*").alias("message_count")
    )


def _name(shard: tuple[str, ...]) -> Column:
    return F.concat_ws("#", *shard) if len(shard) > 1 else F.col(*shard or ("month",))


def list_shards(catalog: DataFrame, cutoff_ms: int | None = None) -> DataFrame:
    """Shards without bounds, or whose last message is not before the cutoff."""
    return catalog if cutoff_ms is None else catalog.where(F.col("max_ts").isNull() | (F.col("max_ts") >= cutoff_ms))


def shard_text(dealt: DataFrame, order: tuple[str, ...] = ("ts_ms", "conv_id", "msg_seq")) -> DataFrame:
    """``shard, text``: texts of each shard of ``deal`` joined by line feeds, in order; ``deal`` bounds their bytes."""
    item = F.struct(*order, "content")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.content), "\n")
    return dealt.groupBy(_name(("month", "shard")).alias("shard")).agg(joined.alias("text"))
