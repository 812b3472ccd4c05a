"""The driver's ``conversations`` table as ``messages``, and the SQL that does the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.scalars import normalize_role
from parlance.functions.text import char_length, markdown_images, utf16_length

BASE_MS, STEP_MS = 1_704_067_200_000, 21_600_000
#: The table has neither times nor models, so both are made from the ids.
MODELS = ["gpt-4o", "gpt-4o-mini", "gpt-4-5", "o1-preview", "web.run", "python", "all", None, "gpt-4o-2024-08-06", "text-davinci-002", "o3-mini-high", "custom-llm"]
NOW_MS = BASE_MS + 800 * 86_400_000


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.col("text")
    model = F.get(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % 12).cast("int"))
    ts = F.lit(BASE_MS) + ((F.col("conv_id") % 100) * 37 + F.col("turn")) * STEP_MS
    return rows.select(
        "conv_id", F.col("turn").alias("msg_seq"), normalize_role(F.col("role")).alias("role"), text.alias("content"), model.alias("model"), ts.alias("ts_ms"),
        char_length(text).alias("char_len"), utf16_length(text).alias("utf16_len"), markdown_images(text).alias("images"),
    )


_LIST = ", ".join("NULL" if m is None else f"'{m}'" for m in MODELS)
MESSAGES_SQL = rf"""
messages AS (
  SELECT conv_id, turn AS msg_seq,
         CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'gpt', 'chatgpt', 'model') THEN 'assistant'
              WHEN lower(trim(role)) = 'system' THEN 'system' END AS role,
         text AS content, [{_LIST}][(conv_id % 12)::INT + 1] AS model,
         {BASE_MS} + ((conv_id % 100) * 37 + turn) * {STEP_MS} AS ts_ms,
         coalesce(length(regexp_replace(text, '\r\n?', chr(10), 'g')), 0) AS char_len,
         coalesce(len(list_distinct(regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)', 1))), 0) AS images
  FROM conversations)"""
