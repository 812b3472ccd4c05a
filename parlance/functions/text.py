"""Column builders for text: masking, lengths, tokens, scripts, n-grams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lexicon as L

CJK_STOP = "|".join(sorted(L.CJK_STOPWORDS, key=len, reverse=True))
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]|[a-z0-9_]+"
LATIN = "^[a-z0-9_]+$"


def mask_pairs(mask) -> list[tuple[str, str]]:
    """Pairs, ``{from|search, to|replace}`` objects or a plain mapping to ordered pairs; empty sources go."""
    if not mask:
        return []
    if isinstance(mask, Mapping):
        pairs = list(mask.items())
    else:
        pairs = []
        for item in mask:
            if isinstance(item, Mapping):
                pairs.append((item.get("from", item.get("search")), item.get("to", item.get("replace", ""))))
            elif isinstance(item, Sequence) and not isinstance(item, str) and len(item) >= 2:
                pairs.append((item[0], item[1]))
    return [(str(a), "" if b is None else str(b)) for a, b in pairs if a]


def mask_text(text: Column, mask) -> Column:
    """Literal, case-sensitive replacements one after the other; ``$`` has no meaning."""
    for old, new in mask_pairs(mask):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def char_length(text: Column) -> Column:
    """Code points with CRLF and CR folded to LF; null counts 0."""
    return F.coalesce(F.char_length(F.regexp_replace(text, "\r\n?", "\n")), F.lit(0)).cast("long")


def utf16_length(text: Column) -> Column:
    return F.coalesce(F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2), F.lit(0)).cast("long")


def markdown_images(text: Column) -> Column:
    """Number of different targets of Markdown image links."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return F.size(F.array_distinct(found))


def tokens(text: Column) -> Column:
    """Lower-cased words and single CJK characters without stopwords, single letters and long numbers."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), CJK_STOP, " ")
    found = F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0))
    alias = F.create_map(*[F.lit(x) for pair in L.ALIAS.items() for x in pair])
    named = F.transform(found, lambda t: F.when(t.isin(*L.ALIAS), F.element_at(alias, t)).otherwise(t))
    return F.filter(named, lambda t: ~t.isin(*L.LATIN_STOPWORDS, *L.CJK_STOPWORDS) & ~t.rlike("^[a-z_]$") & ~t.rlike("^[0-9]{7,}$"))


def script(token: Column) -> Column:
    cjk = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+$"
    return F.when(token.rlike(LATIN), "latin").when(token.rlike(cjk), "cjk").otherwise("other")


def ngrams(words: Column, n: int) -> Column:
    """``struct(n, token, lhs, rhs, start)`` of each run of n tokens of one script; ``words`` must be a plain column.

    Neighbours may have any script; at the text's ends there are sentinels.
    """
    at = lambda i: F.get(words, i)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    same = lambda i: F.size(F.array_distinct(F.transform(F.slice(words, i + 1, n), lambda t: t.rlike(LATIN)))) == 1
    gram = lambda i: F.struct(
        F.lit(n).alias("n"),
        F.array_join(F.slice(words, i + 1, n), " ").alias("token"),
        F.when(i > 0, at(i - 1)).otherwise(L.START).alias("lhs"),
        F.coalesce(at(i + n), F.lit(L.END)).alias("rhs"),
        i.alias("start"),
    )
    return F.transform(F.filter(starts, same), gram)
