"""All registered queries of the analytics engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import scalars, text
from parlance.operators import keywords, models, sketches, timeline, views
from parlance.plans.conversations import MESSAGES_SQL, NOW_MS, messages
from parlance.sources import export, shards

Query = Callable[[SparkSession, str], DataFrame]
SINCE_90, SINCE_365 = scalars.cutoff(NOW_MS, 90), scalars.cutoff(NOW_MS, 365)
MASK = [("the", "[x]"), ("[x] ", "$1 ")]
#: Limits under which all candidates with their parts fit the cap, so that SQL can tell them.
LIMITS = {1: 300, 2: 300, 3: 200}
#: Small limits and a cap that they exceed, for the union's own query.
CAPPED, CAP = {1: 100, 2: 100, 3: 60}, 150
SKETCH = (3, 4096)
SHARD_TEXT_BYTES = 20_000


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.window(messages(spark, sf_dir), SINCE_365).where("role = 'assistant'")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = keywords.token_lists(messages(spark, sf_dir).where("role = 'assistant'"))
    return keywords.heavy_hitters(keywords.gram_counts(keywords.grams(lists, (1,))), {1: 10}).select("token", "freq", "ord")


def _yearly_overview(s, d):
    y = timeline.yearly_aggregate(messages(s, d))
    return y.select("year", "total_messages", "total_chars", "assistant_msgs", "assistant_chars", "images", F.size("active_days").cast("long").alias("n_active_days"))


def _chars_by_month(s, d):
    y = timeline.yearly_aggregate(messages(s, d)).select("year", F.posexplode("chars_by_month").alias("m", "chars"))
    return y.select("year", (F.col("m") + 1).alias("month"), "chars")


def _hours(s, d):
    return timeline.yearly_aggregate(messages(s, d)).select("year", F.posexplode("hour_buckets").alias("hour", "msgs"))


def _days(s, d):
    return timeline.yearly_aggregate(messages(s, d)).select("year", F.explode("active_days").alias("day"))


def _model_buckets(s, d):
    return models.model_buckets(messages(s, d), NOW_MS)


def _share(kind: str, mode: str = "full") -> Query:
    return lambda s, d: models.model_share(messages(s, d), NOW_MS, kind, mode).select("family", "msgs", F.round("share", 9).alias("share"), "rank")


def _families(s, d):
    m = messages(s, d).where("role = 'assistant'").select("conv_id", "msg_seq", "model")
    return m.select("conv_id", "msg_seq", scalars.family_or_class(F.col("model")).alias("family"), scalars.model_family(F.col("model"), "grouped").alias("grouped"))


def _tokens(s, d):
    lists = keywords.token_lists(messages(s, d))
    return lists.select("conv_id", "msg_seq", F.posexplode("words").alias("pos", "token")).withColumn("script", text.script(F.col("token")))


def _counts(n: int) -> Query:
    return lambda s, d: keywords.gram_counts(keywords.grams(keywords.token_lists(_recent(s, d)), (n,))).drop("n")


def _entropy(s, d):
    stats = keywords.neighbour_stats(keywords.grams(keywords.token_lists(_recent(s, d)), (2, 3))).where("freq >= 3")
    return stats.select("n", "token", F.round("left_entropy", 6).alias("left_entropy"), F.round("right_entropy", 6).alias("right_entropy"))


def _hits(s, d, limits) -> DataFrame:
    return keywords.heavy_hitters(keywords.gram_counts(keywords.grams(keywords.token_lists(_recent(s, d)))), limits)


def _scores(s, d):
    return keywords.keyword_scores(_recent(s, d), LIMITS)


def _own_scores(s, d):
    how = keywords.Scoring(alpha=0.5, beta=0.1, gamma=1.3, delta=0.5, min_freq=3, min_pmi=0.5)
    return keywords.keyword_scores(_recent(s, d), LIMITS, MASK, how)


def _view(name: str) -> Query:
    return lambda s, d: views.top_views(_scores(s, d)).where(F.col("view") == name).drop("view")


def _sharded(s, d) -> DataFrame:
    """The assistant's messages with the month as shard."""
    return messages(s, d).where("role = 'assistant'").withColumn("shard", scalars.month_key(F.col("ts_ms")))


def _cross(s, d):
    return sketches.stream_grams(_sharded(s, d)).groupBy("n", "token").agg(F.count("*").alias("freq")).where("freq >= 2")


def _estimates(s, d):
    counts = keywords.gram_counts(keywords.grams(keywords.token_lists(_recent(s, d))))
    return sketches.estimate(counts, sketches.count_min(counts, *SKETCH), *SKETCH)


def _merged(s, d):
    tops, parts, _ = sketches.partials(_sharded(s, d), top={1: 50, 2: 50, 3: 30}, depth=SKETCH[0], width=SKETCH[1])
    return sketches.merge_partials(tops, {1: 100, 2: 100, 3: 0}, parts, *SKETCH)


def _two_views(s, d) -> tuple[DataFrame, DataFrame]:
    """Top words of the recent window, and the same in reverse order as the next ones."""
    before = _hits(s, d, {1: 5, 2: 4}).select(F.when(F.col("n") > 1, "phrases").otherwise("words").alias("view"), F.col("ord").alias("rank"), "token", "n", "freq", F.col("freq").cast("double").alias("score"))
    last = F.when(F.col("view") == "words", 6).otherwise(5)
    return before, before.withColumn("rank", (last - F.col("rank")).cast("int")).withColumn("score", F.col("score") + F.when(F.col("view") == "phrases", 1e-3).otherwise(1e-9))


def _reconcile(s, d):
    kept = views.reconcile(*_two_views(s, d))
    return kept.select("view", "rank", "token", "n", "freq", F.round("score", 6).alias("score"))


def _catalog(s, d):
    m = messages(s, d).where("role = 'assistant'").withColumn("month", scalars.month_key(F.col("ts_ms")))
    return shards.list_shards(shards.shard_catalog(m), SINCE_365)


def _export(s, d):
    """The conversations written as export JSON, one file value each, and read back through the ingest."""
    m = messages(s, d)
    item = F.struct(F.struct(F.col("role").alias("role")).alias("author"), F.col("content"), (F.col("ts_ms") / 1000).alias("create_time"), F.col("model"))
    files = m.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(item).alias("messages"))).alias("value"))
    made = export.normalize(export.parse_conversations(files))
    return made.groupBy("role", "model").agg(F.count("*").alias("msgs"), F.sum("char_len").alias("chars"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))


def _shaped(s, d) -> DataFrame:
    """The conversations as export JSON of all shapes: by id a mapping, items, a list, or nothing known, six levels deep.

    Messages have times in seconds, milliseconds and microseconds, or none of their own; texts as
    parts, as objects or plain; and attachments of which some are images.
    """
    ts, turn, scale = F.col("ts_ms"), F.col("msg_seq"), F.col("msg_seq") % 4
    time = F.when(scale == 0, ts / 1000).when(scale == 1, ts.cast("double")).when(scale == 2, ts * 1000.0)
    text = lambda c: F.struct(F.struct(c.alias("value")).alias("text"))
    image = lambda k: F.struct(k.cast("string").alias("id"), F.lit("image/png").alias("mime_type"), F.lit(None).cast("string").alias("url"))
    linked = F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("mime_type"), F.lit("http://x/y.JPG?z").alias("url"))
    other = F.struct(F.lit("f").alias("id"), F.lit("text/plain").alias("mime_type"), F.lit("http://x/y.txt").alias("url"))
    files = F.when(turn % 2 == 0, F.array(image(turn), image(turn), linked, other)).otherwise(F.array(other))
    plain = F.when(turn % 3 == 1, F.col("content"))
    parts = F.when(turn % 3 == 0, F.array("content", F.lit("end")))
    objects = F.when(turn % 3 == 2, F.array(text(F.col("content"))))
    slug = F.when(turn % 2 == 0, F.col("model"))
    meta = F.struct(F.when(turn % 2 == 1, F.col("model")).alias("default_model"))
    body = F.struct(
        F.struct(F.col("role").alias("role")).alias("author"), plain.alias("content"), F.coalesce(parts, F.array().cast("array<string>")).alias("parts"),
        time.alias("create_time"), slug.alias("model"), meta.alias("metadata"), files.alias("attachments"), turn.cast("string").alias("node"),
    )
    nested = F.when(objects.isNotNull(), F.to_json(body.dropFields("content").withField("content", objects))).otherwise(F.to_json(body))
    rows = messages(s, d).where("role is not null").select("conv_id", "msg_seq", "ts_ms", nested.alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_seq", "m"))).alias("ms"), (F.min("ts_ms") / 1000).cast("long").alias("t"))
    listed = lambda f: F.array_join(F.transform("ms", f), ",")
    body = (
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit('"mapping":{'), listed(lambda x: F.concat(F.lit('"n'), x.msg_seq, F.lit('":{"message":'), x.m, F.lit("}"))), F.lit("}")))
        .when(F.col("conv_id") % 4 == 1, F.concat(F.lit('"items":['), listed(lambda x: F.concat(F.lit('{"data":'), x.m, F.lit("}"))), F.lit("]")))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit('"messages":['), listed(lambda x: F.concat(F.lit('{"message":'), x.m, F.lit("}"))), F.lit("]")))
        .otherwise(F.concat(F.lit('"a":{"b":[[{"c":{"d":['), listed(lambda x: x.m), F.lit("]}}]]}")))
    )
    return grouped.select(F.concat(F.lit('{"create_time":'), "t", F.lit(","), body, F.lit("}")).alias("value"))


def _export_shapes(s, d):
    made = export.normalize(export.parse_conversations(_shaped(s, d)))
    return made.groupBy("role", "model").agg(
        F.count("*").alias("msgs"), F.sum("char_len").alias("chars"), F.sum("images").cast("long").alias("images"), F.min("ts_ms").alias("min_ts"), F.sum(F.col("ts_ms") / 1000).cast("long").alias("seconds")
    )


def _share_models(s, d):
    made = export.normalize(export.parse_conversations(_shaped(s, d)))
    return made.groupBy(F.col("share_model").alias("model")).agg(F.count("*").alias("msgs"))


def _pmi(s, d):
    lists = keywords.token_lists(_recent(s, d))
    return keywords.bigram_pmi(keywords.gram_counts(keywords.grams(lists, (1, 2))), keywords.token_total(lists))


def _bucket_view(s, d):
    v = models.bucket_view(_model_buckets(s, d)).select("month_key", F.col("msgs").alias("total"), F.posexplode_outer("models").alias("pos", "m"))
    return v.select("month_key", "total", "pos", F.col("m.family").alias("family"), F.col("m.msgs").alias("msgs"))


def _bucket_share(s, d):
    every = models.model_buckets(messages(s, d), NOW_MS, "all")
    return models.bucket_share(every, SINCE_365).select("family", "msgs", F.round("share", 9).alias("share"), "rank")


def _dealt(s, d) -> DataFrame:
    return shards.deal(export.emitted(messages(s, d).withColumn("name", F.lit(None).cast("string"))), SHARD_TEXT_BYTES)


def _shard_text(s, d):
    return shards.shard_text(_dealt(s, d))


def _shard_sizes(s, d):
    return shards.shard_catalog(_dealt(s, d), "month", "shard")


def _legacy(s, d):
    return shards.legacy_messages(_shard_text(s, d)).select("shard", "content", "ts_ms")


def _masked(s, d):
    return messages(s, d).select("conv_id", "msg_seq", text.mask_text(F.col("content"), MASK).alias("masked"))


def queries() -> dict[str, Query]:
    return {
        "yearly_overview": _yearly_overview,
        "yearly_metrics": lambda s, d: timeline.yearly_metrics(timeline.yearly_aggregate(messages(s, d))),
        "chars_by_month": _chars_by_month,
        "hour_histogram": _hours,
        "active_days": _days,
        "role_normalized_counts": lambda s, d: messages(s, d).groupBy("role").agg(F.count("*").alias("msgs")),
        "char_lengths": lambda s, d: messages(s, d).select("conv_id", "msg_seq", "char_len", "utf16_len"),
        "markdown_images": lambda s, d: messages(s, d).select("conv_id", "msg_seq", text.markdown_images(F.concat("content", F.lit(" ![a](u) ![b](u) ![c](v)"))).alias("images")),
        "window_90d": lambda s, d: models.window(messages(s, d), SINCE_90).select("conv_id", "msg_seq", "ts_ms"),
        "window_365d": lambda s, d: models.window(messages(s, d), SINCE_365).select("conv_id", "msg_seq", "ts_ms"),
        "model_family": _families,
        "model_share_12m": _share("last12months"),
        "model_share_all": _share("all"),
        "model_share_grouped": _share("all", "grouped"),
        "model_buckets": _model_buckets,
        "unknown_models": lambda s, d: models.unknown_models(messages(s, d)),
        "masked_text": _masked,
        "tokens": _tokens,
        "token_scripts": lambda s, d: _tokens(s, d).groupBy("script").agg(F.count("*").alias("n")),
        "unigram_counts": _counts(1),
        "bigram_counts": _counts(2),
        "trigram_counts": _counts(3),
        "neighbor_entropy": _entropy,
        "heavy_hitters": lambda s, d: _hits(s, d, {1: 1500, 2: 1500, 3: 1000}),
        "candidate_union": lambda s, d: keywords.capped_union(_hits(s, d, LIMITS)).select("n", "token", "is_base"),
        "candidate_closure": lambda s, d: keywords.with_support(_hits(s, d, LIMITS)),
        "candidate_union_capped": lambda s, d: keywords.capped_union(_hits(s, d, CAPPED), CAP),
        "scored_phrases_own_weights": _own_scores,
        "stream_ngrams": _cross,
        "count_min_estimates": _estimates,
        "merged_candidates": _merged,
        "export_shapes": _export_shapes,
        "share_models": _share_models,
        "shard_sizes": _shard_sizes,
        "scored_phrases": _scores,
        "top_phrases": _view("phrases"),
        "top_words": _view("words"),
        "reconcile_views": _reconcile,
        "shard_catalog": _catalog,
        "bigram_pmi": _pmi,
        "model_bucket_view": _bucket_view,
        "model_share_by_month": _bucket_share,
        "shard_text": _shard_text,
        "legacy_shard_lines": _legacy,
        "export_normalize": _export,
    }


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_ALIAS = " ".join(f"WHEN x = '{a}' THEN '{b}'" for a, b in L.ALIAS.items())
_TOKEN = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]|[a-z0-9_]+"
_WORDS = (
    f"list_filter(list_transform(regexp_extract_all(regexp_replace(lower(coalesce(content, '')), '{text.CJK_STOP}', ' ', 'g'), '{_TOKEN}'), "
    f"lambda x: CASE {_ALIAS} ELSE x END), lambda x: x NOT IN ({_quoted(L.LATIN_STOPWORDS + L.CJK_STOPWORDS)}) AND NOT regexp_full_match(x, '[a-z_]') "
    f"AND NOT regexp_full_match(x, '[0-9]{{7,}}'))"
)
_YEAR = "strftime(make_timestamp(ts_ms * 1000), '%Y')"
_AT = "make_timestamp(ts_ms * 1000)"


_TRIMMED = f"trim(model, '{L.SPACE}')"
_TIE = "replace(token, '_', '!'), token"  # the collation of these tokens


def _family_sql(mode: str) -> str:
    m, bare = f"lower({_TRIMMED})", rf"regexp_replace(lower({_TRIMMED}), '-\d{{4}}-\d{{2}}-\d{{2}}$', '')"
    part = lambda i: f"string_split({bare}, '-')[{i}]"
    suffix = f"array_to_string(string_split({bare}, '-')[3:], '-')"
    if mode == "full":
        gpt = rf"CASE WHEN regexp_full_match({suffix}, '\d+') THEN 'GPT-' || {part(2)} || '.' || {suffix} WHEN {suffix} <> '' THEN 'GPT-' || {part(2)} || '-' || {suffix} ELSE 'GPT-' || {part(2)} END"
        o = f"CASE WHEN len(string_split({bare}, '-')) = 1 THEN {bare} ELSE {part(1)} || '-' || {part(2)} END"
    else:
        gpt, o = f"'GPT-' || {part(2)}", rf"regexp_extract({bare}, '^o\d+')"
    return rf"""CASE WHEN coalesce(model, '') = '' THEN NULL
      WHEN regexp_matches({m}, '^(web\.|browser\.|python|computer|canmore)') OR contains({m}, 'tool') OR contains({m}, '_do') OR contains({m}, 'update_') THEN NULL
      WHEN {m} IN ('all', 'bio') OR length({m}) > 50 OR contains({m}, '__') THEN NULL
      WHEN starts_with({m}, 'gpt-') THEN {gpt} WHEN regexp_matches({m}, '^o\d+') THEN {o}
      WHEN contains({m}, 'chatgpt') THEN 'ChatGPT' WHEN contains({m}, 'turbo') THEN 'GPT-3.5-turbo' WHEN contains({m}, 'davinci') THEN 'GPT-3 (davinci)' END"""


_CLASS = r"CASE WHEN regexp_matches(lower(coalesce(model, '')), '^(web\.|browser\.|computer|python|container|canmore)') OR lower(model) = 'all' THEN 'Tools' ELSE 'Unknown' END"
_FULL = f"coalesce({_family_sql('full')}, {_CLASS})"


def _share_sql(since: int, family: str) -> str:
    return f"""WITH {MESSAGES_SQL}, f AS (SELECT {family} AS family FROM messages WHERE role = 'assistant' AND ts_ms >= {since}),
    g AS (SELECT family, count(*) AS msgs FROM f WHERE family IS NOT NULL GROUP BY family)
    SELECT family, msgs, round(msgs / sum(msgs) OVER (), 9) AS share,
           row_number() OVER (ORDER BY CASE family WHEN 'Tools' THEN 1 WHEN 'Unknown' THEN 2 ELSE 0 END, msgs DESC, family)::INT AS rank FROM g"""


_LISTS = f"lists AS (SELECT conv_id, msg_seq, {_WORDS} AS w FROM messages)"
_RECENT = f"lists AS (SELECT conv_id, msg_seq, {_WORDS} AS w FROM messages WHERE role = 'assistant' AND ts_ms >= {SINCE_365})"
_GRAMS = f"""tok AS (SELECT conv_id, msg_seq, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM lists),
    seq AS (SELECT t, regexp_full_match(t, '[a-z0-9_]+') AS lat, lag(t) OVER o AS p1, lead(t) OVER o AS n1, lead(t, 2) OVER o AS n2, lead(t, 3) OVER o AS n3
            FROM tok WINDOW o AS (PARTITION BY conv_id, msg_seq ORDER BY pos)),
    scr AS (SELECT *, regexp_full_match(n1, '[a-z0-9_]+') AS l1, regexp_full_match(n2, '[a-z0-9_]+') AS l2, coalesce(p1, '{L.START}') AS lhs FROM seq),
    grams AS (SELECT 1 AS n, t AS token, lhs, coalesce(n1, '{L.END}') AS rhs FROM scr
      UNION ALL SELECT 2, t || ' ' || n1, lhs, coalesce(n2, '{L.END}') FROM scr WHERE n1 IS NOT NULL AND lat = l1
      UNION ALL SELECT 3, t || ' ' || n1 || ' ' || n2, lhs, coalesce(n3, '{L.END}') FROM scr WHERE n2 IS NOT NULL AND lat = l1 AND l1 = l2),
    counts AS (SELECT n, token, count(*) AS freq FROM grams GROUP BY n, token)"""


def _hit_sql(a: int, b: int, c: int) -> str:
    return f"""hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY freq DESC, {_TIE})::INT AS ord FROM counts)
               WHERE ord <= CASE n WHEN 1 THEN {a} WHEN 2 THEN {b} ELSE {c} END),
    sup AS (SELECT n, token, string_split(token, ' ') AS p FROM hit),
    allc AS (SELECT n, token FROM sup UNION ALL SELECT 1, unnest(p) FROM sup WHERE n > 1
             UNION ALL SELECT 2, p[1] || ' ' || p[2] FROM sup WHERE n = 3 UNION ALL SELECT 2, p[2] || ' ' || p[3] FROM sup WHERE n = 3),
    cand AS (SELECT DISTINCT n, token FROM allc)"""


def _capped_sql(limits: dict[int, int], most: int) -> str:
    """The bundles in their order, and a walk over them that keeps the tokens taken and those whose own bundle entered."""
    return f"""WITH RECURSIVE {MESSAGES_SQL}, {_RECENT}, {_GRAMS}, {_hit_sql(*(limits[n] for n in (1, 2, 3)))},
    u0 AS (SELECT token, 0 AS src, ord, 0 AS spot FROM sup JOIN hit USING (n, token) WHERE n = 1
      UNION ALL SELECT p[spot], n - 1, ord, spot FROM sup JOIN hit USING (n, token) CROSS JOIN (SELECT unnest([1, 2, 3]) AS spot) WHERE n > 1 AND spot <= n),
    b0 AS (SELECT token, 0 AS src, ord, 0 AS spot FROM hit WHERE n = 2
      UNION ALL SELECT p[spot] || ' ' || p[spot + 1], 1, ord, spot FROM sup JOIN hit USING (n, token) CROSS JOIN (SELECT unnest([1, 2]) AS spot) WHERE n = 3),
    every AS (SELECT token, 0 AS pass, ord AS place FROM hit WHERE n = 3
      UNION ALL SELECT token, 1, min(src * 10000000 + ord * 10 + spot) FROM b0 GROUP BY token UNION ALL SELECT token, 2, min(src * 10000000 + ord * 10 + spot) FROM u0 GROUP BY token),
    steps AS (SELECT row_number() OVER (ORDER BY pass, place)::INT AS k, token, string_split(token, ' ') AS p FROM every),
    bundles AS (SELECT k, token, CASE len(p) WHEN 1 THEN [token] WHEN 2 THEN [p[1], p[2], token] ELSE [p[1], p[2], p[3], p[1] || ' ' || p[2], p[2] || ' ' || p[3], token] END AS items FROM steps),
    walk AS (SELECT 0 AS k, []::VARCHAR[] AS taken, []::VARCHAR[] AS base UNION ALL
      SELECT k, CASE WHEN fits THEN list_concat(taken, fresh) ELSE taken END, CASE WHEN fits AND NOT list_contains(base, token) THEN list_append(base, token) ELSE base END
      FROM (SELECT *, len(taken) < {most} AND len(taken) + len(fresh) <= {most} AS fits
            FROM (SELECT b.k, b.token, w.taken, w.base, list_filter(b.items, lambda x, i: NOT list_contains(w.taken, x) AND list_position(b.items, x) = i) AS fresh
                  FROM walk w JOIN bundles b ON b.k = w.k + 1))),
    done AS (SELECT unnest(taken) AS token, generate_subscripts(taken, 1) AS spot, base FROM (SELECT * FROM walk ORDER BY k DESC LIMIT 1)),
    named AS (SELECT len(string_split(token, ' '))::INT AS n, token, list_contains(base, token) AS is_base, spot, list_position(base, token) AS place FROM done)
    SELECT n, token, is_base, row_number() OVER (PARTITION BY n ORDER BY NOT is_base, CASE WHEN is_base THEN place ELSE spot END)::INT AS ord FROM named"""


_ENT = """side AS (SELECT n, token, 'l' AS side, lhs AS nb FROM grams WHERE n > 1 UNION ALL SELECT n, token, 'r', rhs FROM grams WHERE n > 1),
    nbc AS (SELECT n, token, side, nb, count(*) AS c FROM side GROUP BY ALL),
    es AS (SELECT n, token, side, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM nbc GROUP BY n, token, side),
    ent AS (SELECT n, token, max(h) FILTER (side = 'l') AS le, max(h) FILTER (side = 'r') AS re FROM es GROUP BY n, token)"""
def _scored_sql(how: keywords.Scoring) -> str:
    return f"""{_hit_sql(*(LIMITS[n] for n in (1, 2, 3)))}, {_ENT},
    ch AS (SELECT k.n, k.token, k.freq, string_split(k.token, ' ') AS p FROM counts k JOIN cand USING (n, token)),
    tot AS (SELECT sum(len(w)) AS t FROM lists),
    j AS (SELECT ch.*, p[1] AS a, p[2] AS b, p[3] AS c, CASE WHEN n = 3 THEN p[1] || ' ' || p[2] END AS ab, CASE WHEN n = 3 THEN p[2] || ' ' || p[3] END AS bc FROM ch),
    k AS (SELECT j.*, coalesce(fa.freq, 0)::DOUBLE AS fa, coalesce(fb.freq, 0)::DOUBLE AS fb, coalesce(fc.freq, 0)::DOUBLE AS fc, coalesce(fab.freq, 0)::DOUBLE AS fab,
                 coalesce(fbc.freq, 0)::DOUBLE AS fbc, coalesce(le, 0) AS le0, coalesce(re, 0) AS re0, (SELECT t FROM tot)::DOUBLE AS t
          FROM j LEFT JOIN ch fa ON fa.token = j.a LEFT JOIN ch fb ON fb.token = j.b LEFT JOIN ch fc ON fc.token = j.c LEFT JOIN ch fab ON fab.token = j.ab
          LEFT JOIN ch fbc ON fbc.token = j.bc LEFT JOIN ent ON ent.n = j.n AND ent.token = j.token),
    q AS (SELECT *, CASE WHEN fab > 0 AND fa > 0 AND fb > 0 THEN log2(fab * t / (fa * fb)) ELSE 0 END AS x, CASE WHEN fbc > 0 AND fb > 0 AND fc > 0 THEN log2(fbc * t / (fb * fc)) ELSE 0 END AS y FROM k),
    r AS (SELECT *, CASE WHEN n = 2 AND freq >= {how.min_freq} THEN CASE WHEN fa > 0 AND fb > 0 THEN log2(freq * t / (fa * fb)) ELSE 0 END
                         WHEN n = 3 AND freq >= {how.min_freq} THEN CASE WHEN x > 0 AND y > 0 THEN (x + y) / 2 WHEN x > 0 THEN x WHEN y > 0 THEN y
                              WHEN fa * fb * fc > 0 THEN log2(freq * t / (fa * fb * fc)) ELSE 0 END ELSE 0 END AS pmi,
                 CASE WHEN n > 1 AND freq >= {how.min_freq} THEN le0 ELSE 0 END AS left_entropy, CASE WHEN n > 1 AND freq >= {how.min_freq} THEN re0 ELSE 0 END AS right_entropy FROM q),
    z AS (SELECT *, least(left_entropy, right_entropy) AS min_entropy, n > 1 AND freq >= {how.min_freq} AND pmi >= {how.min_pmi} AS passed FROM r),
    pen AS (SELECT unnest(CASE WHEN n = 2 THEN [a, b] ELSE [a, b, c, ab, bc] END) AS token,
                   unnest(CASE WHEN n = 2 THEN [ln({L.UNI_OF_BI}), ln({L.UNI_OF_BI})]
                          ELSE [ln({L.UNI_OF_TRI}), ln({L.UNI_OF_TRI}), ln({L.UNI_OF_TRI}), ln({L.BI_OF_TRI}), ln({L.BI_OF_TRI})] END) AS w FROM z WHERE passed),
    fac AS (SELECT token, exp(sum(w)) AS factor FROM pen GROUP BY token),
    scored AS (SELECT z.token, n, freq, round(pmi, 6) AS pmi, round(left_entropy, 6) AS left_entropy, round(right_entropy, 6) AS right_entropy, round(min_entropy, 6) AS min_entropy,
      round(CASE WHEN n = 1 THEN freq * {how.delta} WHEN passed THEN freq * (1 + {how.alpha} * pmi) * (1 + {how.beta} * min_entropy) * CASE WHEN n = 3 THEN {how.gamma} ELSE 1 END
        * CASE WHEN len(list_filter(p, lambda v: v NOT IN ({_quoted(L.WHITELIST)}))) = 0 THEN {L.WHITELIST_BONUS} ELSE 1 END ELSE 0 END * coalesce(factor, 1), 6) AS score
      FROM z LEFT JOIN fac ON fac.token = z.token)"""


_SCORED = _scored_sql(keywords.Scoring())
_VIEW_SQL = f"""u AS (SELECT *, CASE WHEN n > 1 THEN 'phrases' ELSE 'words' END AS kind FROM scored WHERE freq > 0 AND (score > 0 OR n = 1)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, freq DESC, n, {_TIE})::INT AS rank FROM u) WHERE rank <= {L.TOP_VIEW}),
    np AS (SELECT count(*)::INT AS c FROM best WHERE kind = 'phrases')"""


def oracle_sql() -> dict[str, str]:
    base, recent = f"WITH {MESSAGES_SQL}", f"WITH {MESSAGES_SQL}, {_RECENT}, {_GRAMS}"
    year = f"""y AS (SELECT {_YEAR} AS year, count(*) AS total_messages, sum(char_len)::BIGINT AS total_chars, count(*) FILTER (role = 'assistant') AS assistant_msgs,
      coalesce(sum(char_len) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_chars, sum(images)::BIGINT AS images, count(DISTINCT strftime({_AT}, '%Y-%m-%d')) AS n_active_days FROM messages GROUP BY 1)"""
    months = f"""cm AS (SELECT year, month, coalesce(sum(char_len), 0)::BIGINT AS chars FROM (SELECT DISTINCT {_YEAR} AS year FROM messages) CROSS JOIN (SELECT unnest(range(1, 13))::INT AS month)
      LEFT JOIN (SELECT {_YEAR} AS year, month({_AT})::INT AS month, char_len FROM messages) USING (year, month) GROUP BY 1, 2)"""
    hours = f"""hh AS (SELECT year, hour, count(h) AS msgs FROM (SELECT DISTINCT {_YEAR} AS year FROM messages) CROSS JOIN (SELECT unnest(range(0, 24))::INT AS hour)
      LEFT JOIN (SELECT {_YEAR} AS year, hour({_AT})::INT AS hour, 1 AS h FROM messages) USING (year, hour) GROUP BY 1, 2)"""
    masked = "content"
    for old, new in MASK:
        masked = f"replace({masked}, '{old}', '{new}')"
    dealt = f"""dealt AS (SELECT *, strftime({_AT}, '%Y-%m') || '#' || floor(coalesce(sum(strlen(content) + 1) OVER (PARTITION BY strftime({_AT}, '%Y-%m') ORDER BY ts_ms, conv_id, msg_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {SHARD_TEXT_BYTES})::INT AS shard FROM messages WHERE role = 'assistant')"""
    own_text = f"""{dealt}, st AS (SELECT shard, string_agg(content, chr(10) ORDER BY ts_ms, conv_id, msg_seq) AS text FROM dealt GROUP BY 1)"""
    streamed = f"""lists AS (SELECT conv_id, msg_seq, strftime({_AT}, '%Y-%m') AS shard, {_WORDS} AS w FROM messages WHERE role = 'assistant'),
      stok AS (SELECT shard, conv_id, msg_seq, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM lists),
      sseq AS (SELECT shard, t, lead(t) OVER o AS n1, lead(t, 2) OVER o AS n2 FROM stok WINDOW o AS (PARTITION BY shard ORDER BY conv_id, msg_seq, pos)),
      sl AS (SELECT *, regexp_full_match(t, '[a-z0-9_]+') AS l0, regexp_full_match(n1, '[a-z0-9_]+') AS l1, regexp_full_match(n2, '[a-z0-9_]+') AS l2 FROM sseq),
      sg AS (SELECT shard, 1 AS n, t AS token FROM sl UNION ALL SELECT shard, 2, t || ' ' || n1 FROM sl WHERE n1 IS NOT NULL AND l0 = l1
        UNION ALL SELECT shard, 3, t || ' ' || n1 || ' ' || n2 FROM sl WHERE n2 IS NOT NULL AND l0 = l1 AND l1 = l2)"""
    slot = f"(('0x' || substr(md5(row || ':' || token), 1, 8))::BIGINT % {SKETCH[1]})::INT"
    rows_of = f"CROSS JOIN (SELECT unnest(range({SKETCH[0]}))::INT AS row)"
    shaped = """msg AS (SELECT *, min(ts_ms) OVER (PARTITION BY conv_id) AS conv_ts FROM messages WHERE role IS NOT NULL),
      made AS (SELECT role, model AS own, CASE WHEN msg_seq % 2 = 0 THEN model END AS model, CASE WHEN msg_seq % 3 = 0 THEN CASE WHEN content <> '' THEN content || chr(10) || 'end' ELSE 'end' END ELSE coalesce(content, '') END AS content,
        CASE WHEN msg_seq % 4 = 3 THEN (conv_ts // 1000) * 1000 ELSE ts_ms END AS ts_ms, CASE WHEN msg_seq % 2 = 0 THEN 2 ELSE 0 END AS files FROM msg)"""
    by_month = lambda since: f"""b AS (SELECT strftime({_AT}, '%Y-%m') AS month_key, {_FULL} AS family, count(*) AS n FROM messages WHERE role = 'assistant' AND ts_ms >= {since} GROUP BY 1, 2)"""
    return {
        "bigram_pmi": f"""{recent}, tot AS (SELECT sum(len(w))::DOUBLE AS t FROM lists), o AS (SELECT token, freq FROM counts WHERE n = 1)
          SELECT k.token, k.freq, round(CASE WHEN x.freq > 0 AND y.freq > 0 THEN log2(k.freq * t / (x.freq::DOUBLE * y.freq)) ELSE 0 END, 6) AS pmi FROM counts k CROSS JOIN tot
          LEFT JOIN o x ON x.token = string_split(k.token, ' ')[1] LEFT JOIN o y ON y.token = string_split(k.token, ' ')[2] WHERE k.n = 2""",
        "model_bucket_view": f"""{base}, {by_month(SINCE_365)}, cal AS (SELECT strftime(date_trunc('month', make_timestamp({NOW_MS} * 1000)) - to_months(i::INT), '%Y-%m') AS month_key FROM range(0, 12) r(i))
          SELECT month_key, coalesce(sum(n) OVER (PARTITION BY month_key), 0)::BIGINT AS total, CASE WHEN family IS NOT NULL THEN row_number() OVER (PARTITION BY month_key ORDER BY n DESC, family) - 1 END::INT AS pos,
            family, n AS msgs FROM cal FULL JOIN b USING (month_key)""",
        "model_share_by_month": f"""{base}, {by_month(0)}, g AS (SELECT family, sum(n)::BIGINT AS msgs FROM b WHERE month_key >= strftime(make_timestamp({SINCE_365} * 1000), '%Y-%m') GROUP BY family)
          SELECT family, msgs, round(msgs / sum(msgs) OVER (), 9) AS share, row_number() OVER (ORDER BY CASE family WHEN 'Tools' THEN 1 WHEN 'Unknown' THEN 2 ELSE 0 END, msgs DESC, family)::INT AS rank FROM g""",
        "shard_text": f"{base}, {own_text} SELECT * FROM st",
        "legacy_shard_lines": f"{base}, {own_text} SELECT shard, unnest(string_split(text, chr(10))) AS content, NULL::BIGINT AS ts_ms FROM st",
        "yearly_overview": f"{base}, {year} SELECT * FROM y",
        "yearly_metrics": f"""{base}, {year}, {months}, {hours} SELECT y.*, CASE WHEN n_active_days > 0 THEN floor(total_chars / n_active_days * 10 + 0.5) / 10 ELSE 0.0 END AS avg_chars_per_day,
          CASE WHEN assistant_msgs > 0 THEN floor(assistant_chars / assistant_msgs * 10 + 0.5) / 10 ELSE 0.0 END AS avg_assistant_chars,
          (SELECT month FROM cm WHERE cm.year = y.year ORDER BY chars DESC, month LIMIT 1) AS top_month, (SELECT hour FROM hh WHERE hh.year = y.year ORDER BY msgs DESC, hour LIMIT 1) AS peak_hour FROM y""",
        "chars_by_month": f"{base}, {months} SELECT * FROM cm",
        "hour_histogram": f"{base}, {hours} SELECT * FROM hh",
        "active_days": f"{base} SELECT DISTINCT {_YEAR} AS year, strftime({_AT}, '%Y-%m-%d') AS day FROM messages",
        "role_normalized_counts": f"{base} SELECT role, count(*) AS msgs FROM messages GROUP BY role",
        "char_lengths": rf"{base} SELECT conv_id, msg_seq, char_len, length(content) + len(regexp_extract_all(content, '[\x{{10000}}-\x{{10FFFF}}]')) AS utf16_len FROM messages",
        "markdown_images": rf"{base} SELECT conv_id, msg_seq, len(list_distinct(regexp_extract_all(content || ' ![a](u) ![b](u) ![c](v)', '!\[[^\]]*\]\(([^)]+)\)', 1)))::INT AS images FROM messages",
        "window_90d": f"{base} SELECT conv_id, msg_seq, ts_ms FROM messages WHERE ts_ms >= {SINCE_90}",
        "window_365d": f"{base} SELECT conv_id, msg_seq, ts_ms FROM messages WHERE ts_ms >= {SINCE_365}",
        "model_family": f"{base} SELECT conv_id, msg_seq, {_FULL} AS family, {_family_sql('grouped')} AS grouped FROM messages WHERE role = 'assistant'",
        "model_share_12m": _share_sql(SINCE_365, _FULL),
        "model_share_all": _share_sql(0, _FULL),
        "model_share_grouped": _share_sql(0, _family_sql("grouped")),
        "model_buckets": rf"""{base}, b AS (SELECT strftime({_AT}, '%Y-%m') AS month_key, {_FULL} AS family, count(*) AS msgs,
          sum(length(content) + len(regexp_extract_all(content, '[\x{{10000}}-\x{{10FFFF}}]')))::BIGINT AS chars, sum(len({_WORDS}))::BIGINT AS tokens
          FROM messages WHERE role = 'assistant' AND ts_ms >= {SINCE_365} GROUP BY 1, 2),
          cal AS (SELECT strftime(date_trunc('month', make_timestamp({NOW_MS} * 1000)) - to_months(i::INT), '%Y-%m') AS month_key FROM range(0, 12) r(i))
          SELECT month_key, family, coalesce(msgs, 0) AS msgs, coalesce(chars, 0) AS chars, coalesce(tokens, 0) AS tokens FROM cal FULL JOIN b USING (month_key)""",
        "unknown_models": f"{base} SELECT {_TRIMMED} AS raw_model, least(count(*), 2001) AS n FROM messages WHERE role = 'assistant' AND {_FULL} IN ('Tools', 'Unknown') AND {_TRIMMED} <> '' GROUP BY 1 ORDER BY n DESC, raw_model LIMIT 10",
        "masked_text": f"{base} SELECT conv_id, msg_seq, {masked} AS masked FROM messages",
        "tokens": f"{base}, {_LISTS} SELECT conv_id, msg_seq, (generate_subscripts(w, 1) - 1)::INT AS pos, unnest(w) AS token, CASE WHEN regexp_full_match(unnest(w), '[a-z0-9_]+') THEN 'latin' ELSE 'cjk' END AS script FROM lists",
        "token_scripts": f"{base}, {_LISTS}, t AS (SELECT unnest(w) AS x FROM lists) SELECT CASE WHEN regexp_full_match(x, '[a-z0-9_]+') THEN 'latin' ELSE 'cjk' END AS script, count(*) AS n FROM t GROUP BY 1",
        "unigram_counts": f"{recent} SELECT token, freq FROM counts WHERE n = 1",
        "bigram_counts": f"{recent} SELECT token, freq FROM counts WHERE n = 2",
        "trigram_counts": f"{recent} SELECT token, freq FROM counts WHERE n = 3",
        "neighbor_entropy": f"{recent}, {_ENT} SELECT n, token, round(le, 6) AS left_entropy, round(re, 6) AS right_entropy FROM ent JOIN counts USING (n, token) WHERE freq >= 3",
        "heavy_hitters": f"{recent}, {_hit_sql(1500, 1500, 1000)} SELECT n, token, freq, ord FROM hit",
        "candidate_union": f"{recent}, {_hit_sql(*LIMITS.values())} SELECT n, token, true AS is_base FROM cand",
        "candidate_closure": f"{recent}, {_hit_sql(*LIMITS.values())} SELECT n, token FROM cand",
        "candidate_union_capped": _capped_sql(CAPPED, CAP),
        "scored_phrases_own_weights": f"WITH {MESSAGES_SQL}, {_RECENT.replace('content', f'({masked})')}, {_GRAMS}, {_scored_sql(keywords.Scoring(0.5, 0.1, 1.3, 0.5, 3, 0.5))} SELECT * FROM scored",
        "stream_ngrams": f"{base}, {streamed} SELECT n, token, count(*) AS freq FROM sg GROUP BY n, token HAVING count(*) >= 2",
        "count_min_estimates": f"""{recent}, rows AS (SELECT n, token, freq, row, {slot} AS slot FROM counts {rows_of}), sums AS (SELECT n, row, slot, sum(freq) AS c FROM rows GROUP BY ALL)
          SELECT n, token, min(c)::BIGINT AS estimate FROM rows JOIN sums USING (n, row, slot) GROUP BY n, token""",
        "merged_candidates": f"""{base}, {streamed}, c AS (SELECT shard, n, token, count(*) AS freq FROM sg GROUP BY ALL),
          tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard, n ORDER BY freq DESC, {_TIE}) AS place FROM c) WHERE place <= CASE n WHEN 3 THEN 30 ELSE 50 END),
          rows AS (SELECT n, token, freq, row, {slot} AS slot FROM c {rows_of}), sums AS (SELECT n, row, slot, sum(freq) AS s FROM rows GROUP BY ALL),
          est AS (SELECT n, token, min(s)::BIGINT AS upper FROM (SELECT DISTINCT n, token, row, slot FROM rows) JOIN sums USING (n, row, slot) GROUP BY n, token),
          m AS (SELECT n, token, sum(freq)::BIGINT AS freq FROM tops GROUP BY n, token)
          SELECT * FROM (SELECT n, token, freq, upper, row_number() OVER (PARTITION BY n ORDER BY upper DESC, freq DESC, {_TIE})::INT AS ord FROM m JOIN est USING (n, token)) WHERE n = 3 OR ord <= 100""",
        "export_shapes": rf"""{base}, {shaped} SELECT role, model, count(*) AS msgs, sum(length(regexp_replace(content, '\r\n?', chr(10), 'g')))::BIGINT AS chars,
          sum(files + len(list_distinct(regexp_extract_all(content, '!\[[^\]]*\]\(([^)]+)\)', 1))))::BIGINT AS images, min(ts_ms) AS min_ts, sum(ts_ms // 1000)::BIGINT AS seconds FROM made GROUP BY role, model""",
        "share_models": f"{base}, {shaped} SELECT own AS model, count(*) AS msgs FROM made GROUP BY own",
        "shard_sizes": f"{base}, {dealt} SELECT shard, sum(strlen(content) + 1)::BIGINT AS size, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS message_count FROM dealt GROUP BY shard",
        "scored_phrases": f"{recent}, {_SCORED} SELECT * FROM scored",
        "top_phrases": f"{recent}, {_SCORED}, {_VIEW_SQL} SELECT rank, token, n, freq, score FROM best WHERE kind = 'phrases' UNION ALL SELECT (rank + c)::INT, token, n, freq, score FROM best, np WHERE kind = 'words' AND rank + c <= {L.TOP_VIEW}",
        "top_words": f"{recent}, {_SCORED}, {_VIEW_SQL} SELECT rank, token, n, freq, score FROM best WHERE kind = 'words'",
        "reconcile_views": f"""{recent}, {_hit_sql(5, 4, 0)} SELECT CASE WHEN n > 1 THEN 'phrases' ELSE 'words' END AS view, CASE n WHEN 1 THEN ord ELSE 5 - ord END::INT AS rank, token, n, freq,
          freq::DOUBLE + CASE WHEN n > 1 THEN 1e-3 ELSE 0 END AS score FROM hit""",
        "shard_catalog": f"{base}, c AS (SELECT strftime({_AT}, '%Y-%m') AS shard, sum(strlen(content) + 1)::BIGINT AS size, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS message_count FROM messages WHERE role = 'assistant' GROUP BY 1) SELECT * FROM c WHERE max_ts >= {SINCE_365}",
        "export_normalize": f"{base} SELECT role, model, count(*) AS msgs, sum(char_len)::BIGINT AS chars, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM messages GROUP BY role, model",
    }
