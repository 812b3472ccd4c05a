"""Scalar normalisers: times, roles, model families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.lexicon import DAY_MS, LAST_MS, SPACE


def trim(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(x, F.lit(SPACE))


def normalize_ts(raw: Column) -> Column:
    """Seconds, milliseconds or microseconds to epoch milliseconds; nothing sensible, or no date, gives null."""
    x = raw.try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    ms = F.when(x < 1e12, F.floor(x * 1000 + 0.5)).when(x > 1e15, F.floor(x / 1000 + 0.5)).otherwise(F.floor(x))
    return F.when(ok & (ms <= LAST_MS), ms).cast("long")


def normalize_role(raw: Column) -> Column:
    r = F.lower(trim(raw))
    return F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "gpt", "chatgpt", "model"), "assistant").when(r == "system", "system")


def model_family(raw: Column, mode: str = "full") -> Column:
    """Family of a raw model name, null for tools and unknown names.

    ``full`` keeps variants (``GPT-4o-mini``); ``grouped`` keeps the version only (``GPT-4o``).
    """
    m = F.lower(trim(raw))
    tool = m.rlike(r"^(web\.|browser\.|python|computer|canmore)") | m.contains("tool") | m.contains("_do") | m.contains("update_")
    bad = m.isin("all", "bio") | (F.octet_length(F.encode(m, "UTF-16BE")) > 100) | m.contains("__")
    bare = F.regexp_replace(m, r"-\d{4}-\d{2}-\d{2}$", "")
    parts = F.split(bare, "-")
    version = F.get(parts, F.lit(1))
    suffix = F.array_join(F.slice(parts, 3, 100), "-")
    label = F.concat(F.lit("GPT-"), version)
    if mode == "full":
        label = F.when(suffix.rlike(r"^\d+$"), F.concat(label, F.lit("."), suffix)).when(suffix != "", F.concat(label, F.lit("-"), suffix)).otherwise(label)
        o_label = F.when(F.size(parts) == 1, bare).otherwise(F.concat_ws("-", F.get(parts, F.lit(0)), version))
    else:
        o_label = F.regexp_extract(bare, r"^o\d+", 0)
    gpt = F.when(version.isNull(), "GPT (other)").otherwise(label)
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None))
        .when(tool | bad, F.lit(None))
        .when(m.startswith("gpt-"), gpt)
        .when(m.rlike(r"^o\d+"), o_label)
        .when(m.contains("chatgpt"), "ChatGPT")
        .when(m.contains("turbo"), "GPT-3.5-turbo")
        .when(m.contains("davinci"), "GPT-3 (davinci)")
    )


def tool_or_unknown(raw: Column) -> Column:
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low.rlike(r"^(web\.|browser\.|computer|python|container|canmore)") | (low == "all"), "Tools").otherwise("Unknown")


def family_or_class(raw: Column, mode: str = "full") -> Column:
    """Family, or Tools / Unknown; in ``grouped`` mode names without a family are null."""
    family = model_family(raw, mode)
    return family if mode == "grouped" else F.coalesce(family, tool_or_unknown(raw))


def cutoff(now_ms: int, days: int) -> int:
    return now_ms - days * DAY_MS


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def utc(ts_ms: Column) -> Column:
    """The UTC date and time, without a zone: the session's time zone has no part in it."""
    ts = F.when(F.abs(ts_ms) <= LAST_MS, ts_ms)
    within = (F.pmod(ts, F.lit(DAY_MS)) / 1000).cast("decimal(18,6)")
    since = F.make_dt_interval(F.floor(ts / DAY_MS).cast("int"), F.lit(0), F.lit(0), within)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since


def month_key(ts_ms: Column) -> Column:
    return F.date_format(utc(ts_ms).cast("date"), "yyyy-MM")
