"""Structured Streaming forms of the incremental statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.functions.lexicon import DAY_MS
from parlance.functions.scalars import family_or_class
from parlance.operators.timeline import yearly_aggregate


def yearly_stream(messages: DataFrame, checkpoint: str, name: str | None = None, path: str | None = None) -> StreamingQuery:
    """Yearly counts in complete mode; late and undated messages are never dropped.

    One row a year goes to the table ``name`` in memory, or as Parquet to ``path``, a folder for each batch.
    """
    rows = yearly_aggregate(messages).select("year", "total_messages", "total_chars", "assistant_msgs", "assistant_chars", "images")
    out = rows.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    if path is None:
        return out.format("memory").queryName(name).start()
    return out.foreachBatch(lambda batch, no: batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={no}")).start()


def daily_families(messages: DataFrame) -> DataFrame:
    """``day, family, msgs`` of the assistant's messages with a time: what rolling shares need."""
    rows = messages.where((F.col("role") == "assistant") & F.col("ts_ms").isNotNull())
    family = family_or_class(F.col("model"))
    return rows.groupBy(F.floor(F.col("ts_ms") / DAY_MS).alias("day"), family.alias("family")).agg(F.count("*").alias("msgs"))


def rolling_share(partial: DataFrame, since_ms: int) -> DataFrame:
    """``family, msgs, share`` of whole days from ``since_ms`` on, from ``daily_families`` rows of any number of batches."""
    sums = partial.where(F.col("day") >= since_ms // DAY_MS).groupBy("family").agg(F.sum("msgs").alias("msgs"))
    return sums.withColumn("share", F.col("msgs") / F.sum("msgs").over(Window.partitionBy()))


def rolling(
    messages: DataFrame, checkpoint: str, store: str, statistic: Callable[[DataFrame], None], partial: Callable[[DataFrame], DataFrame] = daily_families
) -> StreamingQuery:
    """Reduce each batch by ``partial``, keep that in ``store`` and run ``statistic`` over all that is kept, as windows move with time.

    What is kept grows with days and families, not with messages. A batch replaces its own
    folder, so a batch that runs again does not count twice.
    """

    def each(batch: DataFrame, no: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{store}/batch={no}")
        statistic(batch.sparkSession.read.parquet(store).drop("batch"))

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events in time windows, with a watermark for late ones."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return at.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
