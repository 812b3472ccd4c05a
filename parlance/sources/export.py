"""Chat exports in JSON to the ``messages`` table.

A file is one array of conversations or one conversation. Every conversation becomes a VARIANT,
and its messages come from ``messages``, ``mapping`` and ``items``; these add up. Only a
conversation with none of them is searched for message-like objects, as deep as it goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.scalars import normalize_role, normalize_ts
from parlance.functions.text import char_length, utf16_length
from parlance.sources.split import read_elements

# Names that exports give to these things, in the order in which they are looked up.
IMAGE_URL = r"(?i)\.(png|jpe?g|gif|webp|bmp|svg|heic|heif|tiff?|avif)(\?|#|$)"
MIME_SLOTS = ["mime_type", "content_type", "mime", "media_type", "file.mime_type", "file.content_type", "file.media_type"]
KEY_SLOTS = ["id", "file_id", "file.id", "url", "file.url", "file.name"]
URL_SLOTS = ["url", "href", "link", "file.url", "source", "download_url"]
ATTACHMENT_LISTS = ["attachments", "files", "assets", "metadata.attachments", "metadata.files"]


def _any(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _string(v: Column, path: str) -> Column:
    """The value at ``path`` if it is a string with characters."""
    own = _any(v, path)
    return F.when(_kind(own) == "STRING", F.nullif(F.try_variant_get(v, f"$.{path}", "string"), F.lit("")))


def _self_string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")))


def _truthy(v: Column, path: str) -> Column:
    """A number or string at ``path`` as text, null for null, 0, false and the empty string."""
    raw = F.when(~_is_object(_any(v, path)), F.try_variant_get(v, f"$.{path}", "string"))
    return F.when(~raw.isin("", "0", "0.0", "false", "null"), raw)


def _first(*cols: Column) -> Column:
    return F.coalesce(*cols)


def _allow_repeated_keys(spark: SparkSession) -> None:
    """JSON of exports may repeat a key; the setting stays, as files are parsed when a result is read."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, conv``: one row a conversation; junk before the first bracket is skipped, bad values are dropped."""
    _allow_repeated_keys(spark)
    files = spark.read.text(path, wholetext=True)
    return parse_conversations(files)


def read_large(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_conversations``, for files that no task could hold: arrays are read in blocks, only other roots whole."""
    _allow_repeated_keys(spark)
    elements, other = read_elements(spark, path)
    parsed = elements.select(F.xxhash64("file", "owner", "no").alias("conv_id"), F.try_parse_json("raw").alias("conv"))
    parsed = parsed.where(_is_object(F.col("conv")))
    return parsed.unionByName(parse_conversations(spark.read.text(other, wholetext=True))) if other else parsed


def parse_conversations(files: DataFrame, col: str = "value") -> DataFrame:
    body = F.regexp_replace(F.col(col), r"^[^\[{]+", "")
    elements = F.when(body.startswith("["), F.from_json(body, "array<string>")).otherwise(F.array(body))
    rows = files.select(F.posexplode(elements).alias("pos", "raw"), F.xxhash64(col).alias("file"))
    parsed = rows.select(F.xxhash64("file", "pos").alias("conv_id"), F.try_parse_json("raw").alias("conv"))
    return parsed.where(_is_object(F.col("conv")))


def _shapes(conversations: DataFrame) -> DataFrame:
    """``conv_id, conv, msg`` of the three shapes."""
    c = F.col("conv")
    lists = lambda name: F.try_variant_get(c, f"$.{name}", "array<variant>")
    node = F.col("x")
    pick = lambda *paths: F.coalesce(*[F.when(_is_object(_any(node, p)), _any(node, p)) for p in paths], F.when(_is_object(node), node)).alias("msg")
    listed = lambda name, *paths: conversations.select("conv_id", "conv", F.explode(lists(name)).alias("x")).select("conv_id", "conv", pick(*paths))
    nodes = F.map_values(F.try_variant_get(c, "$.mapping", "map<string,variant>"))
    mapped = conversations.select("conv_id", "conv", F.explode(nodes).alias("x")).select("conv_id", "conv", pick("message", "data.message"))
    return listed("messages", "message").unionByName(mapped).unionByName(listed("items", "message", "data")).where(F.col("msg").isNotNull())


def _holds(value) -> bool:
    """Whether a JSON value counts as given: not null, false, 0 or empty text."""
    return not (value is None or value is False or value == "" or (isinstance(value, (int, float)) and value == 0))


def found_messages(value) -> Iterator[dict]:
    """Objects with a role of their own or of their author, at any depth; found ones are not looked into."""
    waiting = [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, list):
            waiting += x
        elif isinstance(x, dict):
            author = x.get("author")
            if _holds(x.get("role")) or (isinstance(author, dict) and _holds(author.get("role"))):
                yield x
            else:
                waiting += x.values()


def _searched(conversations: DataFrame) -> DataFrame:
    """Message-like objects of conversations without a known shape.

    The depth of a tree is not known beforehand, so Python walks it; these conversations are the exception.
    """
    none = [F.coalesce(_kind(_any(F.col("conv"), k)), F.lit("VOID")) == "VOID" for k in ("messages", "mapping", "items")]
    odd = conversations.where(none[0] & none[1] & none[2]).select("conv_id", F.to_json("conv").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column("raw").to_pylist()):
                tree = json.loads(raw)
                head = {k: tree.get(k) for k in ("create_time", "update_time", "timestamp", "current_node")}
                found = [json.dumps(m) for m in found_messages(tree)]
                if found:
                    ids = pa.concat_arrays([b.column("conv_id").slice(i, 1)] * len(found))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([json.dumps(head)] * len(found)), pa.array(found)], names=["conv_id", "conv", "msg"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = odd.mapInArrow(run, f"conv_id {kind}, conv string, msg string")
    return rows.select("conv_id", F.try_parse_json("conv").alias("conv"), F.try_parse_json("msg").alias("msg"))


def _texts(v: Column, path: str) -> Column:
    """Texts of an array of strings, ``{text}`` and ``{text: {value}}``."""
    items = F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    found = F.transform(items, lambda p: F.coalesce(_self_string(p), _string(p, "text"), F.when(_is_object(p), _string(p, "text.value"))))
    return F.filter(found, lambda t: t.isNotNull())


def content_text(m: Column) -> Column:
    """All texts of a message joined by line feeds."""
    first = F.concat(F.filter(F.array(_string(m, "content")), lambda t: t.isNotNull()), _texts(m, "content"), _texts(m, "parts"))
    nested = F.filter(F.array(F.coalesce(_string(m, "content.text"), _string(m, "content.text.value"))), lambda t: t.isNotNull())
    return F.array_join(F.when(F.size(first) > 0, first).otherwise(F.concat(nested, _texts(m, "content.parts"))), "\n")


def _image_key(a: Column) -> Column:
    """Key of an attachment that is an image; null otherwise."""
    mime = F.exists(F.array(*[_string(a, p) for p in MIME_SLOTS]), lambda x: F.coalesce(F.lower(x).startswith("image/"), F.lit(False)))
    named = [F.coalesce(F.lower(_string(a, p)), F.lit("")) for p in ("type", "category", "purpose")]
    typed = named[0].contains("image") | named[1].contains("image") | named[2].contains("image")
    name = F.concat(named[0], F.lit(":"), F.coalesce(_string(a, "name"), _string(a, "filename"), F.lit("")))
    url = _first(*[_truthy(a, p) for p in URL_SLOTS])
    return F.when(mime | typed, _first(*[_truthy(a, p) for p in KEY_SLOTS], name)).when(url.rlike(IMAGE_URL), url)


def image_count(m: Column, content: Column) -> Column:
    """Different images among attachments and Markdown links."""
    lists = [F.coalesce(F.try_variant_get(m, f"$.{p}", "array<variant>"), F.array().cast("array<variant>")) for p in ATTACHMENT_LISTS]
    items = F.concat(*lists)
    both = F.concat(items, F.transform(items, lambda i: _any(i, "file")))
    keys = F.transform(F.filter(both, lambda i: _is_object(i)), _image_key)
    links = F.regexp_extract_all(content, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return F.size(F.array_distinct(F.filter(F.concat(keys, links), lambda k: k.isNotNull())))


def ingest_model(m: Column) -> Column:
    """Raw model name of an exported message; the recipient comes last."""
    return _first(*[_string(m, p) for p in ("model", "model_slug", "metadata.model_slug", "metadata.default_model_slug", "metadata.model", "recipient")])


def share_model(m: Column) -> Column:
    """Raw model name as the share statistics look it up."""
    return _first(*[_string(m, p) for p in ("model", "metadata.model", "metadata.default_model", "author_metadata.model", "model_slug")])


def normalize(conversations: DataFrame) -> DataFrame:
    """``conv_id, role, name, content, model, share_model, ts_ms, char_len, utf16_len, images`` of every message."""
    raw = _shapes(conversations).unionByName(_searched(conversations))
    c, m = F.col("conv"), F.col("msg")
    conv_ts = F.coalesce(normalize_ts(_first(*[_truthy(c, p) for p in ("create_time", "update_time", "timestamp")])), normalize_ts(_truthy(c, "current_node.message.create_time")))
    own_ts = normalize_ts(_first(*[_truthy(m, p) for p in ("create_time", "update_time", "end_turn.time", "ts")]))
    role = normalize_role(_first(_string(m, "role"), _string(m, "author.role"), _string(m, "author")))
    name = _first(_string(m, "name"), _string(m, "author.name"))
    made = raw.select(
        "conv_id", role.alias("role"), name.alias("name"), ingest_model(m).alias("model"), share_model(m).alias("share_model"), F.coalesce(own_ts, conv_ts).alias("ts_ms"), "msg",
        F.explode(F.array(content_text(m))).alias("content"),
    )
    text = F.col("content")
    return made.select(
        "conv_id", "role", "name", "content", "model", "share_model", "ts_ms", char_length(text).alias("char_len"), utf16_length(text).alias("utf16_len"),
        image_count(m, text).alias("images"),
    )


def emitted(messages: DataFrame, assistant_name: str | None = None) -> DataFrame:
    """Messages to keep in shards: the assistant's, of one name if given."""
    own = messages.where("role = 'assistant'")
    return own.where(F.coalesce("name", F.lit("")) == assistant_name) if assistant_name else own


def from_shards(shards: DataFrame) -> DataFrame:
    """Messages of stored shards for the statistics: from ``messages array<struct<text, ts>>`` where given, else from ``text``.

    A message without text goes, as does one whose time is no number; shards of neither form give none.
    """
    has = lambda c, kind: F.col(c) if c in shards.columns else F.lit(None).cast(kind)
    listed = F.transform(has("messages", "array<struct<text: string, ts: double>>"), lambda x: F.struct(x.text.alias("content"), x.ts.cast("long").alias("ts_ms")))
    whole = F.when(has("text", "string").isNotNull(), F.array(F.struct(has("text", "string").alias("content"), F.lit(None).cast("long").alias("ts_ms"))))
    rows = shards.select("shard", F.posexplode(F.coalesce(listed, whole)).alias("msg_seq", "m")).select("shard", "msg_seq", "m.content", "m.ts_ms")
    return rows.where(F.coalesce("content", F.lit("")) != "")
