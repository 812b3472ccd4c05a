"""Shards, buckets, user-supplied aggregates, times in other zones, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from parlance import registry
from parlance.functions import scalars
from parlance.operators import keywords, models, sketches, timeline
from parlance.plans import progress
from parlance.sources import export, shards
from parlance.streaming import incremental

SF = "/root/testdata/sf0.001"
DAY = 86_400_000
JAN, MAR = 1_704_067_200_000, 1_709_251_200_000  # 2024-01-01, 2024-03-01
MESSAGES = "conv_id long, msg_seq long, role string, name string, content string, model string, ts_ms long, char_len long, images int"
ROWS = [
    (1, 1, "assistant", "x", "one", "gpt-4o", JAN, 3, 0), (1, 2, "user", None, "two\nlines", None, JAN + 1, 9, 0), (1, 3, "assistant", None, "late", "o1-preview", MAR - 1, 4, 1),
    (2, 1, "assistant", "x", "march", "gpt-4o", MAR, 5, 0), (2, 2, "assistant", None, None, None, None, 0, 0), (2, 3, None, None, "huge", None, 1 << 60, 4, 0),
]


@pytest.fixture
def msgs(spark):
    return spark.createDataFrame(ROWS, MESSAGES)


@pytest.fixture
def zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_shards_round_trip(spark, msgs, tmp_path):
    path = str(tmp_path / "shards")
    shards.write_shards(export.emitted(msgs), path)
    assert sorted((r["month"], r["content"]) for r in shards.read_shards(spark, path).collect()) == [("2024-01", "one"), ("2024-02", "late"), ("2024-03", "march"), ("none", None)]
    assert sorted(r["content"] for r in shards.read_shards(spark, path, MAR - 1).collect()) == ["late", "march"]
    assert [r["content"] for r in shards.read_shard(spark, path, "2024-02").collect()] == ["late"]
    plan = shards.read_shard(spark, path, "2024-02")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    shards.write_shards(export.emitted(msgs, "x"), path, "overwrite")
    assert shards.read_shards(spark, path).count() == 2
    assert shards.clear_shards(spark, path) and not shards.clear_shards(spark, path)


def test_legacy_lines_keep_other_columns(spark):
    got = shards.legacy_messages(spark.createDataFrame([(7, "a\n\nb"), (8, "")], "id long, text string")).collect()
    assert [(r["id"], r["content"], r["ts_ms"]) for r in got] == [(7, "a", None), (7, "", None), (7, "b", None), (8, "", None)]


def test_catalog_keeps_shards_without_bounds(msgs):
    found = shards.shard_catalog(msgs.withColumn("month", scalars.month_key(F.col("ts_ms"))))
    kept = {r["shard"]: (r["size"], r["message_count"]) for r in shards.list_shards(found.where("shard is null or shard < '3'"), MAR).collect()}
    assert kept["2024-03"] == (6, 1) and "2024-01" not in kept


def test_utc_whatever_the_session_zone(spark, msgs, zone):
    years = {r["year"]: r for r in timeline.yearly_aggregate(msgs).collect()}
    assert years["2024"]["active_days"] == ["2024-01-01", "2024-02-29", "2024-03-01"]
    assert years["2024"]["chars_by_month"][:4] == [12, 4, 5, 0]
    assert years["unknown"]["total_messages"] == 2
    buckets = models.model_buckets(msgs, MAR, "all")
    assert {(r["month_key"], r["family"], r["msgs"]) for r in buckets.collect()} == {("2024-01", "GPT-4o", 1), ("2024-02", "o1-preview", 1), ("2024-03", "GPT-4o", 1)}
    assert [(r["family"], r["msgs"]) for r in models.bucket_share(buckets, MAR - 1).orderBy("rank").collect()] == [("GPT-4o", 1), ("o1-preview", 1)]
    assert [(r["family"], r["msgs"]) for r in models.bucket_share(buckets, MAR).collect()] == [("GPT-4o", 1)]


def test_hours_of_a_zone(msgs):
    got = {r["year"]: r["hour_buckets"] for r in timeline.yearly_aggregate(msgs, "Asia/Tokyo").collect()}
    assert [h for h, n in enumerate(got["2024"]) if n] == [8, 9]


def test_absurd_times_have_no_date(spark):
    raw = spark.createDataFrame([("1e30",), ("9e18",), ("1e15",), ("8.64e18",), ("Infinity",)], "x string")
    assert [r[0] for r in raw.select(scalars.normalize_ts(F.col("x"))).collect()] == [None, None, 10**15, 8_640_000_000_000_000, None]


def test_coerced_years_have_metrics(spark):
    raw = spark.createDataFrame(
        [("2023", "10", 5, ["1", "x", None, "7"], ["d", "d", None]), (None, "1", 1, None, None), ("2024", None, None, None, None)],
        "year string, total_messages string, total_chars long, chars_by_month array<string>, active_days array<string>",
    )
    made = timeline.coerce_years(raw)
    got = {r["year"]: r for r in made.collect()}
    assert set(got) == {"2023", "2024"} and got["2023"]["chars_by_month"] == [1, 0, 0, 7] + [0] * 8
    assert got["2023"]["hour_buckets"] == [0] * 24 and got["2023"]["active_days"] == ["d"] and got["2023"]["total_messages"] == 10
    metrics = {r["year"]: r for r in timeline.yearly_metrics(made).collect()}
    assert (metrics["2023"]["top_month"], metrics["2023"]["peak_hour"], metrics["2023"]["avg_chars_per_day"]) == (4, 0, 5.0)
    assert (metrics["2024"]["top_month"], metrics["2024"]["avg_chars_per_day"]) == (1, 0.0)


def test_hitters_are_limited_before_the_exchange(spark):
    plan = registry.queries()["heavy_hitters"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    few = spark.createDataFrame([(1, f"t{i}", i) for i in range(20)] + [(2, "a b", 3)], "n int, token string, freq long")
    got = keywords.heavy_hitters(few, {1: 3, 2: 5}).collect()
    assert sorted((r["n"], r["ord"], r["token"]) for r in got) == [(1, 1, "t19"), (1, 2, "t18"), (1, 3, "t17"), (2, 1, "a b")]


def test_streams_agree_with_batches(spark, msgs, tmp_path):
    for i in range(2):
        msgs.where(F.col("conv_id") == i + 1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = lambda: spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = incremental.yearly_stream(stream(), str(tmp_path / "c1"), "years_now")
    query.processAllAvailable()
    query.stop()
    want = timeline.yearly_aggregate(msgs).select("year", "total_messages", "total_chars", "images").collect()
    assert sorted(map(tuple, spark.table("years_now").select("year", "total_messages", "total_chars", "images").collect())) == sorted(map(tuple, want))
    seen = []
    rolling = incremental.rolling(stream(), str(tmp_path / "c2"), str(tmp_path / "store"), lambda df: seen.append({r["family"]: r["msgs"] for r in incremental.rolling_share(df, JAN).collect()}))
    rolling.processAllAvailable()
    rolling.stop()
    assert seen[-1] == {r["family"]: r["msgs"] for r in models.model_share(msgs.where(f"ts_ms >= {JAN}"), MAR, "all").collect()}
    snapshot = incremental.yearly_stream(stream(), str(tmp_path / "c3"), path=str(tmp_path / "years"))
    snapshot.processAllAvailable()
    snapshot.stop()
    last = max((tmp_path / "years").glob("batch=*"), key=lambda p: int(p.name.partition("=")[2]))
    assert spark.read.parquet(str(last)).count() == len(want)


def test_event_windows(spark):
    got = incremental.event_counts(spark.read.parquet(f"{SF}/events.parquet"))
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").where("ts is not null").count()


def test_shards_are_dealt_by_bytes(spark, tmp_path):
    rows = [(i // 10, i % 10, "assistant", None, "x" * (i % 97), None, JAN + i * 3_600_000 // 7 if i % 50 else None, 0, 0) for i in range(1, 800)]
    msgs = spark.createDataFrame(rows, MESSAGES)
    dealt = shards.deal(msgs, 2_000).collect()
    assert len(dealt) == len(rows)
    at, size = {}, {}
    for r in sorted(dealt, key=lambda r: (r["month"], r["ts_ms"] or 0, r["conv_id"], r["msg_seq"])):
        key, n = (r["month"], r["shard"]), len(r["content"]) + 1
        size[key] = size.get(key, 0) + n
        if r["month"] != "none":  # those without a time go by hash
            assert r["shard"] == at.get(r["month"], 0) // 2_000
        at[r["month"]] = at.get(r["month"], 0) + n
    assert max(size.values()) < 2_000 + 98 and len(size) > 15
    path = str(tmp_path / "s")
    assert shards.stored_bytes(spark, path) == 0
    shards.write_shards(msgs, path, shard_bytes=2_000)
    assert shards.read_shards(spark, path).count() == len(rows) and shards.stored_bytes(spark, path) > 0
    one = shards.read_shard(spark, path, "2024-01", 1)
    assert one.count() > 0 and one.agg(F.sum(F.octet_length("content") + 1)).first()[0] < 2_098


def test_stored_shards_as_messages(spark):
    rows = [("a", "one\ntwo", None), ("b", None, [("x", 5.0), (None, 1.0), ("", 2.0), ("y", None)]), ("c", None, None)]
    made = spark.createDataFrame(rows, "shard string, text string, messages array<struct<text: string, ts: double>>")
    got = sorted((r["shard"], r["msg_seq"], r["content"], r["ts_ms"]) for r in export.from_shards(made).collect())
    assert got == [("a", 0, "one\ntwo", None), ("b", 0, "x", 5), ("b", 3, "y", None)]
    assert export.from_shards(made.drop("messages")).count() == 1


def test_sketches_are_never_under_the_count(spark):
    counts = spark.createDataFrame([(1, f"t{i}", i % 9 + 1) for i in range(500)], "n int, token string, freq long")
    parts = [counts.where(F.pmod(F.hash("token"), F.lit(3)) == k) for k in range(3)]
    whole = sketches.count_min(counts, 3, 128)
    merged = sketches.merge_sketches(sketches.count_min(parts[0], 3, 128).unionByName(sketches.count_min(parts[1], 3, 128)).unionByName(sketches.count_min(parts[2], 3, 128)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.select("n", "row", "slot", "c").collect()))
    got = {r["token"]: r["estimate"] for r in sketches.estimate(counts.select("n", "token"), whole, 3, 128).collect()}
    assert all(got[f"t{i}"] >= i % 9 + 1 for i in range(500))
    wide = {r["token"]: r["estimate"] for r in sketches.estimate(spark.createDataFrame([(1, "t8"), (1, "none")], "n int, token string"), sketches.count_min(counts)).collect()}
    assert wide == {"t8": 9, "none": 0}


def test_partials_of_the_older_form_merge(spark):
    tops = spark.createDataFrame([("a", " x ", 3), ("b", "x", 4), ("b", "", 9), ("b", "y_1", 7), ("b", "y1", 7), ("a", None, 1)], "shard string, token string, count_est long")
    got = sketches.merge_partials(tops, {1: 3, 2: 3, 3: 3}).orderBy("ord").collect()
    assert [(r["token"], r["freq"], r["upper"]) for r in got] == [("x", 7, 7), ("y_1", 7, 7), ("y1", 7, 7)]


def test_ingest_reports_and_keeps_what_is_there(spark, tmp_path):
    files = []
    for k in range(3):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps([{"create_time": 1700000000, "messages": [{"role": "assistant", "content": f"hello {k} {i}"} for i in range(4)]}]))
        files.append(str(path))
    seen = []
    store = str(tmp_path / "store")
    got = progress.ingest(spark, files, store, on_progress=lambda done, of: seen.append((done, of)), should_stop=lambda: len(seen) == 2)
    assert (got.files, got.messages, got.complete, seen) == (2, 8, False, [(1, 3), (2, 3)]) and got.stored_bytes > 0
    assert progress.ingest(spark, files[2:], store).complete and shards.read_shards(spark, store).count() == 12


def test_jobs_are_watched_and_cancelled(spark):
    seen = []
    with progress.watched(spark, lambda done, of: seen.append((done, of)), every=0.05):
        assert spark.range(0, 100_000, 1, 16).selectExpr("sum(id)").first()[0] == 4_999_950_000
    assert seen and seen[-1][0] <= seen[-1][1]
    slow = F.pandas_udf(lambda x: (__import__("time").sleep(20), x)[1], "long")
    with pytest.raises(Exception, match="(?i)cancel"):  # noqa: PT012, SIM117
        with progress.watched(spark, should_stop=lambda: True, every=0.3):
            spark.range(0, 8, 1, 8).select(slow("id")).collect()
