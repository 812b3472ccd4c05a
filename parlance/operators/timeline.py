"""Yearly overview: totals, month and hour histograms, active days, derived metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.scalars import round1, utc


def yearly_aggregate(messages: DataFrame, hour_tz: str = "UTC") -> DataFrame:
    """One row a UTC year ('unknown' without a valid time) of ``messages(role, ts_ms, char_len, images)``."""
    ok = F.coalesce(F.col("ts_ms") > 0, F.lit(False))
    at = utc(F.col("ts_ms"))
    ok = ok & at.isNotNull()
    rows = messages.select(
        F.when(ok, F.date_format(at.cast("date"), "yyyy")).otherwise("unknown").alias("year"),
        F.when(ok, F.month(at)).alias("month"),
        F.when(ok, F.hour(F.convert_timezone(F.lit("UTC"), F.lit(hour_tz), at))).alias("hour"),
        F.when(ok, F.date_format(at.cast("date"), "yyyy-MM-dd")).alias("day"),
        (F.col("role") == "assistant").alias("own"),
        "char_len", "images",
    )
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy("year").agg(
        F.count("*").alias("total_messages"),
        count("char_len").alias("total_chars"),
        count(F.when(F.col("own"), F.col("char_len"))).alias("assistant_chars"),
        count(F.when(F.col("own"), 1)).alias("assistant_msgs"),
        F.array(*[count(F.when(F.col("month") == m, F.col("char_len"))) for m in range(1, 13)]).alias("chars_by_month"),
        F.array(*[count(F.when(F.col("hour") == h, 1)) for h in range(24)]).alias("hour_buckets"),
        count("images").alias("images"),
        F.array_sort(F.collect_set("day")).alias("active_days"),
    )


def coerce_years(years: DataFrame) -> DataFrame:
    """Aggregates from elsewhere as ``yearly_aggregate`` makes them: what is missing or no finite number counts 0.

    Months are filled up to 12 and hours to 24; days are distinct. Rows without a year go.
    """
    def number(c: Column) -> Column:
        x = c.try_cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x).cast("long")

    have = lambda c, kind: F.col(c) if c in years.columns else F.lit(None).cast(kind)
    filled = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: number(F.get(have(c, "array<long>"), i))).alias(c)
    days = F.coalesce(have("active_days", "array<string>"), F.array().cast("array<string>"))
    totals = ["total_messages", "total_chars", "assistant_chars", "assistant_msgs"]
    return years.where("year is not null").select(
        "year", *[number(have(c, "long")).alias(c) for c in totals], filled("chars_by_month", 12), filled("hour_buckets", 24),
        number(have("images", "long")).alias("images"), F.array_sort(F.array_distinct(F.array_compact(days))).alias("active_days"),
    )


def yearly_metrics(years: DataFrame) -> DataFrame:
    """Averages, most active month (1 if all are 0) and peak hour of ``yearly_aggregate`` rows."""
    days = F.size("active_days")
    first = lambda c: F.array_position(c, F.array_max(c)).cast("int")
    ratio = lambda a, b: F.when(b > 0, round1(a / b)).otherwise(0.0)
    return years.select(
        "year", "total_messages", "total_chars", "assistant_msgs", "assistant_chars", "images", days.cast("long").alias("n_active_days"),
        ratio(F.col("total_chars"), days).alias("avg_chars_per_day"), ratio(F.col("assistant_chars"), F.col("assistant_msgs")).alias("avg_assistant_chars"),
        first("chars_by_month").alias("top_month"), (first("hour_buckets") - 1).alias("peak_hour"),
    )
