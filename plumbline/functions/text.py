"""Text functions on columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = "的 了 和 是 在 于 与 及 或 将 把 被 对 从 一个 一种 什么 哪些 是否 怎么样 如何".split()
ENGLISH_STOPWORDS = "a an and are as at be been but by for from has have if in into is it its of on or that the their them there these this to was were will with".split()
NEGATIVE_WORDS = ("不", "无", "未", "尚", "仅", "禁止", "不能", "否", "no", "not", "none", "never", "unable")
ABSTENTION_PATTERNS = ("unable to determine", "unable to answer", "cannot determine", "cannot answer", "无法确定", "无法回答", "证据不足")


def terms(text: Column) -> Column:
    """Chinese characters, then lower-cased Latin words and numbers, without stopwords."""
    every = F.concat(F.regexp_extract_all(text, F.lit("([\\u4e00-\\u9fff])")), F.regexp_extract_all(F.lower(text), F.lit("([A-Za-z0-9]+)")))
    return F.filter(every, lambda x: ~x.isin(STOPWORDS + ENGLISH_STOPWORDS))


def words(text: Column) -> Column:
    """Lower-cased Unicode word tokens, stopwords and repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?U)(\\w+)"))


def light_token_count(text: Column) -> Column:
    """Latin words or numbers, and single Chinese characters."""
    return F.regexp_count(text, F.lit("[A-Za-z0-9]+|[\\u4e00-\\u9fff]"))


def has_negative(text: Column) -> Column:
    """Whether a negative word occurs as a substring; case counts."""
    found = F.lit(False)
    for word in NEGATIVE_WORDS:
        found = found | F.contains(text, F.lit(word))
    return found


def is_abstention(text: Column) -> Column:
    found = F.lit(False)
    for pattern in ABSTENTION_PATTERNS:
        found = found | F.contains(F.lower(text), F.lit(pattern))
    return found


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^(?U)\\s+|(?U)\\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences cut after terminators; never an empty list."""
    cut = F.filter(F.transform(F.split(text, "(?<=[。！？])|(?<=[.!?])\\s+|\\n+"), strip), lambda s: s != "")
    return F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit("")))


def passages(text: Column) -> Column:
    """Numbered passages ("passage 1: ...") as (id, text); one passage where there is no such header."""
    cut = F.split(text, "(?i)(?:^|\\n\\s*)passage\\s+(?=\\d+\\s*:)")
    parts = F.slice(cut, 2, F.size(cut))
    named = F.transform(parts, lambda p: F.struct(F.concat(F.lit("passage_"), F.regexp_extract(p, "^\\d+", 0)).alias("id"), strip(F.regexp_replace(p, "^\\d+\\s*:", "")).alias("text")))
    alone = F.array(F.struct(F.lit("passage_1").alias("id"), strip(text).alias("text")))
    return F.filter(F.when(F.size(parts) > 0, named).otherwise(alone), lambda p: p["text"] != "")


def evidence_document(contexts: Column) -> Column:
    """(id, text) contexts as one document with a header for each."""
    return F.array_join(F.transform(contexts, lambda c: F.concat(F.lit("[Evidence "), c["id"], F.lit("]\n"), c["text"])), "\n\n")


def occurrences(text: Column, quote: Column) -> Column:
    """All 0-based places of ``quote``, also overlapping ones: the text is cut before each, and lengths are summed."""
    none = F.array().cast("array<int>")
    ahead = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split(text, ahead)
    ends = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), none, lambda at, p: F.concat(at, F.array(F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(0)) + F.char_length(p))))
    found = F.concat(F.when(text.startswith(quote), F.array(F.lit(0))).otherwise(none), ends)
    return F.when((F.char_length(quote) > 0) & F.contains(text, quote), found).otherwise(none)


def draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only, wherever the row is."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
