"""Sentence-level statements of an answer, with exact offsets.

Dots that end no sentence are masked by a sign of the same length, signs are put
where a statement ends, and the text is split at them; the lengths of what comes
before give each statement's offset in the original.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrow import bounded_batches

CUT, DOT = "\u0001", "\u0002"
# Fixed values.
ABBREVIATIONS = "dr|mr|mrs|ms|prof|sr|jr|e\\.g|i\\.e|vs|no|fig|approx"
CONJUNCTION = "(?iU)\\b(?:and|as well as|while|whereas)\\b|以及|并且|同时|而且"
LONG_TOKENS, COMPOUND_TOKENS = 80, 40


def marked(text: Column) -> Column:
    for pattern, to in (
        (f"[{CUT}{DOT}]", " "),
        ("(?md)^([ \\t]*\\d{1,2})\\.(?=\\s)", f"$1{DOT}"),
        (f"\\.(?<=(?<![A-Za-z.])(?i:{ABBREVIATIONS})\\.)(?![.!?])", DOT),
        ("(?<![A-Za-z.])((?:[A-Za-z]\\.)+[A-Za-z])\\.(?![.!?])", f"$1{DOT}"),
        ("(?<![.!?])\\.(?=[^\\s.!?])", DOT),
        ("([。！？；;]+|[.!?]+)", f"$1{CUT}"),
        ("(\\r?\\n+)", f"{CUT}$1{CUT}"),
        (f"(?<![^\\s{CUT}])(\\d{{1,2}}[)）]\\s+)", f"{CUT}$1"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def split_claims(df: DataFrame, key: str, text_col: str, long_tokens: int = LONG_TOKENS, compound_tokens: int = COMPOUND_TOKENS, keep: tuple[str, ...] = (), spans: str | None = None) -> DataFrame:
    """``key``, the columns ``keep``, ``claim_no``, ``claim``, ``claim_start``, ``claim_end``, ``token_count``, ``features``, ``review_reasons``.

    Nothing is shuffled: a text's segments stay in its row until their offsets,
    running sums of their lengths, are known.  Only the segments go through
    Python; ``keep`` does not, and what is not asked for of it is not copied.  A
    null text has no statement.  ``spans`` names an array of structs with
    ``start`` and ``end``: each statement then has ``spans``, those that share a
    place with it, in their order, found by binary searches.
    """
    bounded_batches(df.sparkSession)
    segments = F.split(marked(F.col(text_col)), CUT)
    if spans:
        end = lambda name: F.coalesce(F.transform(spans, lambda s: s[name].cast("int")), F.array().cast("array<int>"))
        placed = df.select(key, *keep, spans, F.arrow_udf(_placed, PLACED)(segments, end("start"), end("end")).alias("parts"))
        whole = lambda p: F.struct(*(p[c].alias(c) for c in ("claim_no", "claim_start", "lead", "claim", "token_count")), F.transform(p["hits"], lambda i: F.get(spans, i)).alias("spans"))
        placed = placed.select(key, *keep, F.transform("parts", whole).alias("parts"))
    else:
        none = F.array().cast("array<int>")
        placed = df.select(key, *keep, F.arrow_udf(_placed, PLACED)(segments, none, none).alias("parts"))
    parts = placed.select(key, *keep, F.inline_outer("parts")).where("claim_no is not null")  # a plain inline has the function called twice
    if not spans:
        parts = parts.drop("hits")
    sign = F.substring(F.regexp_replace("lead", "(?U)^\\s+", ""), 1, 1)
    features = F.when(sign == "", F.array().cast("array<string>")).when(sign.rlike("\\d"), F.array(F.lit("numbered_list_item"))).otherwise(F.array(F.lit("bullet_list_item")))
    tokens = F.col("token_count")
    reasons = F.array_compact(F.array(F.when(tokens > long_tokens, "long_claim"), F.when((tokens >= compound_tokens) & F.col("claim").rlike(CONJUNCTION), "possible_compound_claim")))
    end = F.col("claim_start") + F.char_length("claim")
    return parts.select(key, *keep, "claim_no", "claim", "claim_start", end.alias("claim_end"), "token_count", features.alias("features"), reasons.alias("review_reasons"), *(["spans"] if spans else []))


PLACED = "array<struct<claim_no:int,claim_start:int,lead:string,claim:string,token_count:int,hits:array<int>>>"
TOKEN = "[A-Za-z0-9]+|[\\x{4e00}-\\x{9fff}]"
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LEAD = f"(?s)^(?P<lead>[{SPACE}]*(?:(?:\\p{{Nd}}{{1,2}}[.)）、]|[-*•])[{SPACE}]+)?)(?P<rest>[^{SPACE}].*)$"


def _hits(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, span_starts: pa.Array, span_ends: pa.Array) -> pa.Array:
    """For each statement (in order within its text, without overlap) the numbers of its text's spans that share a place with it."""
    a, b = (x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in (span_starts, span_ends))  # nulls are NaN
    text = pc.list_parent_indices(span_starts).to_numpy()
    number = np.arange(len(text)) - np.searchsorted(text, text)
    step = float(max(ends.max(initial=0), np.nan_to_num(b).max(initial=0)) + 1)
    sound = ~(np.isnan(a) | np.isnan(b))
    a, b, text, number = np.clip(a[sound], 0, step), np.clip(b[sound], 0, step - 1), text[sound], number[sound]
    low = np.searchsorted(ends + owner * step, a + text * step, "right")  # the first statement that ends behind the span's start
    high = np.searchsorted(starts + owner * step, b + text * step, "left")  # the first that starts at its end or behind
    many = np.maximum(high - low, 0)
    span = np.repeat(np.arange(len(low)), many)
    claim = low[span] + np.arange(len(span)) - (np.cumsum(many) - many)[span]
    order = np.lexsort((span, claim))
    sizes = np.bincount(claim, minlength=len(starts)) if len(claim) else np.zeros(len(starts), int)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(number[span[order]].astype(np.int32)))


def _placed(lists: pa.Array, span_starts: pa.Array, span_ends: pa.Array) -> pa.Array:
    """Of each text's segments those with a statement: number, offset in the text, what leads it in, the statement, its light tokens and which spans it meets."""
    each = pc.replace_substring(lists.flatten(), DOT, ".")
    owner = pc.list_parent_indices(lists).to_numpy()
    found = pc.extract_regex(each, LEAD)
    lead = pc.fill_null(pc.struct_field(found, "lead"), "")
    claim = pc.fill_null(pc.struct_field(found, "rest"), "")
    for trimmed in (SPACE, "。！？；;.!?", SPACE):
        claim = pc.utf8_rtrim(claim, trimmed)
    n = pc.utf8_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.searchsorted(owner, owner)  # the first segment of the same text
    before = np.cumsum(n) - n
    start = before - before[first] + pc.utf8_length(lead).to_numpy(zero_copy_only=False)
    said = pc.not_equal(claim, "").to_numpy(zero_copy_only=False)
    count = np.cumsum(said)
    number = count - (count - said)[first]
    at = pa.array(np.flatnonzero(said))
    claim = claim.take(at)
    hits = _hits(start[said].astype(float), start[said] + pc.utf8_length(claim).to_numpy(zero_copy_only=False).astype(float), owner[said], span_starts, span_ends)
    columns = [pa.array(number[said].astype(np.int32)), pa.array(start[said].astype(np.int32)), lead.take(at), claim, pc.count_substring_regex(claim, TOKEN).cast(pa.int32()), hits]
    ends = np.r_[0, np.cumsum(np.bincount(owner[said], minlength=len(lists)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=["claim_no", "claim_start", "lead", "claim", "token_count", "hits"]))


#: The same in SQL; {src} has the columns k and t.
SPLIT_SQL = r"""
s0 as (select k, regexp_replace(t, '[\x01\x02]', ' ', 'g') t from {src}),
s1 as (select k, regexp_replace(t, '(?m)^([ \t]*[0-9]{{1,2}})\.(\s)', '\1' || chr(2) || '\2', 'g') t from s0),
s2 as (select k, regexp_replace(regexp_replace(t, '(?i)(^|[^A-Za-z.])(@ABBREVIATIONS)\.([^.!?]|$)', '\1\2' || chr(2) || '\3', 'g'), '(?i)(^|[^A-Za-z.])(@ABBREVIATIONS)\.([^.!?]|$)', '\1\2' || chr(2) || '\3', 'g') t from s1),
s3 as (select k, regexp_replace(regexp_replace(t, '(^|[^A-Za-z.])((?:[A-Za-z]\.)+[A-Za-z])\.([^.!?]|$)', '\1\2' || chr(2) || '\3', 'g'), '(^|[^A-Za-z.])((?:[A-Za-z]\.)+[A-Za-z])\.([^.!?]|$)', '\1\2' || chr(2) || '\3', 'g') t from s2),
s4 as (select k, regexp_replace(regexp_replace(t, '(^|[^.!?])\.([^\s.!?])', '\1' || chr(2) || '\2', 'g'), '(^|[^.!?])\.([^\s.!?])', '\1' || chr(2) || '\2', 'g') t from s3),
s5 as (select k, regexp_replace(t, '([。！？；;]+|[.!?]+)', '\1' || chr(1), 'g') t from s4),
s6 as (select k, regexp_replace(t, '(\r?\n+)', chr(1) || '\1' || chr(1), 'g') t from s5),
s7 as (select k, regexp_replace(regexp_replace(t, '(^|\s|\x01)([0-9]{{1,2}}[)）]\s+)', '\1' || chr(1) || '\2', 'g'), '(^|\s|\x01)([0-9]{{1,2}}[)）]\s+)', '\1' || chr(1) || '\2', 'g') t from s6),
parts as (select k, unnest(string_split(t, chr(1))) seg, generate_subscripts(string_split(t, chr(1)), 1) part from s7),
placed as (select k, part, translate(seg, chr(2), '.') seg, coalesce(sum(length(seg)) over (partition by k order by part rows between unbounded preceding and 1 preceding), 0) at0 from parts),
led as (select *, regexp_extract(seg, '^(\s*(?:(?:[0-9]{{1,2}}[.)）、]|[-*•])\s+)?)\S', 1) lead from placed),
cored as (select *, regexp_replace(substr(seg, length(lead) + 1), '\s*[。！？；;.!?]*\s*$', '') claim from led),
claims as (select k, lead, cast(row_number() over (partition by k order by part) as integer) claim_no, claim, cast(at0 + length(lead) as integer) claim_start, cast(at0 + length(lead) + length(claim) as integer) claim_end,
  cast(len(regexp_extract_all(claim, '[A-Za-z0-9]+|[一-鿿]')) as integer) token_count from cored where claim != '')
""".replace("@ABBREVIATIONS", ABBREVIATIONS)
