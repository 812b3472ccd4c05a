"""Model families: shares, month buckets, unknown names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.scalars import cutoff, family_or_class, month_key, trim, utc
from parlance.functions.text import tokens, utf16_length


def window(messages: DataFrame, since_ms: int) -> DataFrame:
    """Messages with a time at or after ``since_ms``; there is no upper end."""
    return messages.where(F.col("ts_ms") >= since_ms)


def _own(messages: DataFrame, since_ms: int, mode: str) -> DataFrame:
    rows = window(messages, since_ms).where(F.col("role") == "assistant")
    return rows.withColumn("family", family_or_class(F.col("model"), mode)).where(F.col("family").isNotNull())


def _since(now_ms: int, kind: str) -> int:
    return cutoff(now_ms, 365) if kind == "last12months" else 0


def model_buckets(messages: DataFrame, now_ms: int, kind: str = "last12months", mode: str = "full") -> DataFrame:
    """``month_key, family, msgs, chars, tokens``; for the last 12 months, empty months have a null family."""
    rows = _own(messages, _since(now_ms, kind), mode).select(
        month_key(F.col("ts_ms")).alias("month_key"), "family", utf16_length(F.col("content")).alias("chars"), F.size(tokens(F.col("content"))).alias("n")
    )
    sums = rows.groupBy("month_key", "family").agg(F.count("*").alias("msgs"), F.sum("chars").alias("chars"), F.sum("n").alias("tokens"))
    if kind != "last12months":
        return sums
    month = F.trunc(utc(F.lit(now_ms)).cast("date"), "month")
    months = sums.sparkSession.range(1).select(F.explode(F.sequence(F.add_months(month, -11), month, F.expr("interval 1 month"))).alias("m"))
    calendar = months.select(F.date_format("m", "yyyy-MM").alias("month_key"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return calendar.join(sums, "month_key", "full_outer").select("month_key", "family", zero("msgs"), zero("chars"), zero("tokens"))


def bucket_view(buckets: DataFrame) -> DataFrame:
    """``month_key, msgs, models``: one row a month, models by messages descending, then label."""
    pair = F.struct((-F.col("msgs")).alias("minus"), F.col("family").alias("family"), F.col("msgs").alias("msgs"))
    listed = F.array_sort(F.collect_list(F.when(F.col("family").isNotNull() & (F.col("msgs") > 0), pair)))
    return buckets.groupBy("month_key").agg(F.sum("msgs").alias("msgs"), F.transform(listed, lambda x: F.struct(x.family.alias("family"), x.msgs.alias("msgs"))).alias("models"))


def model_share(messages: DataFrame, now_ms: int, kind: str = "last12months", mode: str = "full") -> DataFrame:
    """``family, msgs, share, rank``: named families by messages, then Tools, then Unknown."""
    return _ranked(_own(messages, _since(now_ms, kind), mode).groupBy("family").agg(F.count("*").alias("msgs")))


def bucket_share(buckets: DataFrame, since_ms: int = 0) -> DataFrame:
    """The same from month buckets: whole months count, unless they end before ``since_ms``."""
    kept = buckets.where((F.col("msgs") > 0) & F.col("family").isNotNull() & (F.col("month_key") >= month_key(F.lit(since_ms))))
    return _ranked(kept.groupBy("family").agg(F.sum("msgs").alias("msgs")))


def _ranked(sums: DataFrame) -> DataFrame:
    last = F.when(F.col("family") == "Tools", 1).when(F.col("family") == "Unknown", 2).otherwise(0)
    whole = Window.partitionBy()
    ranked = sums.withColumn("share", F.col("msgs") / F.sum("msgs").over(whole))
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(last, F.desc("msgs"), "family")))


def unknown_models(messages: DataFrame, limit: int = 10, most: int = 2001) -> DataFrame:
    """The most frequent raw names without a family, with or without a time; counts stop at ``most``."""
    rows = messages.where((F.col("role") == "assistant") & family_or_class(F.col("model")).isin("Tools", "Unknown") & (trim(F.col("model")) != ""))
    sums = rows.groupBy(trim(F.col("model")).alias("raw_model")).agg(F.least(F.count("*"), F.lit(most)).alias("n"))
    return sums.orderBy(F.desc("n"), "raw_model").limit(limit)
