"""Document-and-statement pairs: from raw records to responses, and from responses to pairs.

A response holds its contexts and spans as arrays, so a statement meets the
spans of its answer inside its own row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import evidence_document, passages, strip
from plumbline.operators.claims import COMPOUND_TOKENS, LONG_TOKENS, split_claims
from plumbline.operators.spans import BOUNDARY_CHARS, CONFLICT_TYPES, LOW_CLAIM_RATIO, LOW_SPAN_RATIO, UNSUPPORTED_TYPES

PAIR_SCHEMA, RESPONSE_SCHEMA, SPLIT_RULES, PROJECTION, POLICY = "pair_v3", "response_v1", "sentence_v3", "overlap_v1", "all_contexts"
CARRIED = ("schema_version", "source_id", "query", "source", "task_type", "split", "quality", "generator_model", "temperature")
SPAN = "struct<start:int,end:int,text:string,label_type:string>"


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share ``key`` that with the highest ``order`` stays."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("row")).select("row.*")


def filtered_responses(responses: DataFrame, sources: DataFrame, *, task_type: str = "QA", quality: str = "good", split: str = "all", response_id: str | None = None, require_spans: bool = False, order: str | None = None) -> DataFrame:
    """Raw responses with their source's columns as the struct ``src``; ``all`` switches a filter off.

    Responses without a source go.  Of sources that share an id the last by
    ``order`` counts; without it their ids are taken as unique.
    """
    if order:
        sources = last_of_each(sources, "source_id", order)
    told = sources.select("source_id", F.struct("*").alias("src"))
    if task_type != "all":
        told = told.where(F.col("src.task_type") == task_type)
    rows = responses
    for column, wanted in (("quality", quality), ("split", split)):
        if wanted != "all":
            rows = rows.where(F.col(column) == wanted)
    if response_id is not None:
        rows = rows.where(F.col("id") == response_id)
    if require_spans:
        rows = rows.where(F.size("labels") > 0)
    return rows.join(told, "source_id")


def converted(filtered: DataFrame) -> DataFrame:
    """Canonical responses: a question and its passages, else the prompt and one context."""
    asks = F.col("src.task_type") == "QA"
    alone = F.array(F.struct(F.lit("source_context").alias("id"), F.col("src.source_info.text").alias("text")))
    return filtered.select(
        F.lit(RESPONSE_SCHEMA).alias("schema_version"), F.col("id").cast("string").alias("qid"), "source_id", F.col("src.task_type").alias("task_type"), F.col("src.source").alias("source"),
        "split", F.col("model").alias("generator_model"), "temperature", "quality", F.when(asks, F.col("src.source_info.question")).otherwise(F.col("src.prompt")).alias("query"),
        F.when(asks, passages(F.col("src.source_info.passages"))).otherwise(alone).alias("contexts"), F.col("response").alias("answer"),
        F.col("labels").alias("gold_spans"), (F.size("labels") > 0).alias("gold_hallucinated"),
    )


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by an explicit order; a table has none of its own."""
    return rows.orderBy(order).limit(n)


def document_of(contexts: Column) -> tuple[Column, Column]:
    """The document of stripped contexts and their ids; a context without id is named by its place."""
    named = F.transform(contexts, lambda c, i: F.struct(F.coalesce(F.nullif(c["id"], F.lit("")), F.concat(F.lit("passage_"), i + 1)).alias("id"), strip(c["text"]).alias("text")))
    return evidence_document(named), F.transform(named, lambda c: c["id"])


def document_passages(document: Column) -> Column:
    """(id, text) of a document's passages, the inverse of ``document_of``; null for another format."""
    marked = F.regexp_replace(document, "(?:^|\\n\\n)\\[Evidence ([^\\]\\n]+)\\]\\n", "\u0001$1\u0002")
    parts = F.slice(F.split(marked, "\u0001"), 2, F.size(F.split(marked, "\u0001")))
    read = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\u0002", 1).alias("id"), F.substr(p, F.char_length(F.substring_index(p, "\u0002", 1)) + 2).alias("text")))
    return F.when(marked.startswith("\u0001"), read)


def passages_of(document: Column, ids: Column) -> Column:
    """(id, text) of the passages of ``document_of``'s document, walked by its ids; null where ids and document do not agree.

    Lines of a passage that look like a header of another id cut nothing.
    """
    heads = F.transform(ids, lambda x: F.concat(F.lit("[Evidence "), x, F.lit("]\n")))

    def step(s, i):
        mark = F.concat(F.lit("\n\n"), F.get(heads, i + 1))
        body = F.substr(s["rest"], F.char_length(F.get(heads, i)) + 1)
        text = F.when(mark.isNull(), body).otherwise(F.call_function("substring_index", body, mark, F.lit(1)))
        sound = s["sound"] & F.startswith(s["rest"], F.get(heads, i)) & F.coalesce(F.contains(body, mark), F.lit(True))
        read = F.struct(F.get(ids, i).alias("id"), text.alias("text"))
        return F.struct(F.substr(body, F.char_length(text) + 3).alias("rest"), F.concat(s["read"], F.array(read)).alias("read"), sound.alias("sound"))

    start = F.struct(document.alias("rest"), F.array().cast("array<struct<id:string,text:string>>").alias("read"), (F.size(ids) > 0).alias("sound"))
    walked = F.aggregate(F.slice(F.sequence(F.lit(0), F.size(ids)), 1, F.size(ids)), start, step)
    return F.when(walked["sound"], walked["read"])


def overlap_details(spans: Column, start: Column, end: Column) -> Column:
    """How each overlapping span shares characters with [start, end)."""
    def told(s):
        a, b = F.greatest(start, s["start"]), F.least(end, s["end"])
        return F.struct(
            s["label_type"].alias("label_type"), s["start"].alias("span_start"), s["end"].alias("span_end"), a.alias("overlap_start"), b.alias("overlap_end"), (b - a).alias("overlap_chars"),
            F.round((b - a) / (end - start), 6).alias("claim_overlap_ratio"), F.round((b - a) / (s["end"] - s["start"]), 6).alias("span_coverage_ratio"),
            (a == start).alias("touches_claim_start"), (b == end).alias("touches_claim_end"),
        )

    return F.transform(spans, told)


def union_chars(details: Column) -> Column:
    """Characters in at least one of the overlaps."""
    places = F.array_sort(F.transform(details, lambda d: F.struct(d["overlap_start"].alias("a"), d["overlap_end"].alias("b"))))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["reach"]))).alias("n"), F.greatest(s["reach"], x["b"]).alias("reach"))
    return F.aggregate(places, begin, step)["n"]


def label_rules(spans: Column) -> Column:
    """True where a span has no type, or one that is not known: such rows have no label."""
    return F.exists(spans, lambda s: ~F.coalesce(s["label_type"].isin(*CONFLICT_TYPES, *UNSUPPORTED_TYPES), F.lit(False)))


def projected_label(spans: Column) -> Column:
    has = lambda kinds: F.exists(spans, lambda s: s["label_type"].isin(*kinds))
    return F.when(label_rules(spans), F.raise_error(F.concat(F.lit("unknown span type in "), F.to_json(spans))).cast("string")).when(has(CONFLICT_TYPES), "conflict").when(has(UNSUPPORTED_TYPES), "unsupported").otherwise("supported")


def projection_reasons(spans: Column, details: Column, low_claim: float = LOW_CLAIM_RATIO, low_span: float = LOW_SPAN_RATIO, edge_chars: int = BOUNDARY_CHARS) -> Column:
    """Why a projected label should be looked at again, in the order in which the reasons come up."""
    has = lambda kinds: F.exists(spans, lambda s: s["label_type"].isin(*kinds))
    none = F.array().cast("array<string>")
    whole = F.array_compact(F.array(F.when(F.exists(spans, lambda s: s["label_type"].startswith("Subtle ")), "subtle_gold_span"), F.when(has(CONFLICT_TYPES) & has(UNSUPPORTED_TYPES), "mixed_gold_types"), F.when(F.size(spans) > 1, "multiple_gold_spans")))
    each = F.transform(details, lambda d: F.array_compact(F.array(
        F.when(d["claim_overlap_ratio"] < low_claim, "low_claim_overlap"), F.when(d["span_coverage_ratio"] < low_span, "span_split_across_claims"),
        F.when((d["touches_claim_start"] | d["touches_claim_end"]) & (d["overlap_chars"] <= edge_chars), "boundary_only_overlap"),
    )))
    return F.array_distinct(F.concat(whole, F.coalesce(F.flatten(each), none)))


def response_pairs(responses: DataFrame, dataset: str = "answers", long_tokens: int = LONG_TOKENS, compound_tokens: int = COMPOUND_TOKENS) -> DataFrame:
    """A row for each statement of each response, with its document, its place, its gold label and why to review it.

    ``responses`` has qid, answer, contexts and gold_spans; columns of
    ``CARRIED`` that it lacks are null.  Responses without a statement give no
    row (``response_rules`` finds them); a span of unknown type is an error.
    """
    document, ids = document_of(F.col("contexts"))
    source = responses.select(
        F.col("qid").cast("string").alias("qid"), F.col("answer").alias("response"), document.alias("document"), ids.alias("document_ids"),
        F.coalesce(F.col("gold_spans"), F.array()).cast(f"array<{SPAN}>").alias("all_spans"), *((F.col(c) if c in responses.columns else F.lit(None).cast("string")).alias(c) for c in CARRIED),
    )
    claims = split_claims(source, "qid", "response", long_tokens, compound_tokens, keep=("response", "document", "document_ids", *CARRIED), spans="all_spans").withColumnRenamed("spans", "gold_spans")
    start, end = F.col("claim_start"), F.col("claim_end")
    claims = claims.withColumn("gold_overlap_details", overlap_details(F.col("gold_spans"), start, end))
    claims = claims.withColumn("gold_overlap_char_count", union_chars(F.col("gold_overlap_details")))
    number = F.lpad(F.col("claim_no").cast("string"), F.greatest(F.lit(2), F.char_length(F.col("claim_no").cast("string"))), F.lit("0"))
    reasons = F.array_distinct(F.concat("review_reasons", projection_reasons(F.col("gold_spans"), F.col("gold_overlap_details"))))
    return claims.select(
        F.lit(PAIR_SCHEMA).alias("schema_version"), F.coalesce("schema_version", F.lit(RESPONSE_SCHEMA)).alias("response_schema_version"), F.concat("qid", F.lit("_c"), number).alias("pair_id"),
        "qid", "source_id", F.concat(F.lit("c"), number).alias("claim_id"), F.coalesce("query", F.lit("")).alias("query"), "document", "document_ids", F.lit(POLICY).alias("evidence_policy"), "response", "claim", "claim_start", "claim_end",
        F.col("token_count").alias("claim_token_count"), F.col("features").alias("split_features"), F.lit(SPLIT_RULES).alias("split_rule_version"), projected_label(F.col("gold_spans")).alias("gold_label"),
        F.array_sort(F.array_distinct(F.transform("gold_spans", lambda s: s["label_type"]))).alias("gold_label_raw"), "gold_spans", F.lit(PROJECTION).alias("gold_projection_version"), "gold_overlap_details",
        "gold_overlap_char_count", F.round(F.col("gold_overlap_char_count") / (end - start), 6).alias("gold_claim_coverage_ratio"), (F.size(reasons) > 0).alias("review_flag"), reasons.alias("review_reasons"),
        F.lit(dataset).alias("dataset"), "source", "task_type", "split", "quality", "generator_model", "temperature",
    )


def response_rules() -> dict[str, Column]:
    """What a response must have before it becomes pairs."""
    blank = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == ""
    return {"qid": blank("qid"), "answer": blank("answer"), "contexts": F.coalesce(F.size("contexts"), F.lit(0)) < 1, "context_text": F.exists("contexts", lambda c: F.coalesce(strip(c["text"]), F.lit("")) == "")}


def pair_rules(labels: tuple[str, ...] = ("supported", "conflict", "unsupported")) -> dict[str, Column]:
    """What a pair must have before a judge sees it."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    return {**{f"blank_{c}": blank(c) for c in ("pair_id", "qid", "claim_id", "document", "claim")}, "gold_label": ~F.coalesce(F.col("gold_label").isin(*labels), F.lit(False))}


def variant(pairs: DataFrame, document: Column, ids: Column) -> DataFrame:
    """The same pairs over another document."""
    return pairs.withColumns({"document": document, "document_ids": ids})


def span_scores(rows: DataFrame, key: str, predicted: str = "predicted_spans", gold: str = "gold_spans") -> DataFrame:
    """Precision, recall and F1 by characters of each row's two span arrays; two empty ones agree wholly."""
    def pieces(c):
        sorted_ = F.array_sort(F.transform(F.coalesce(F.col(c), F.array()), lambda s: F.struct(s["start"].cast("int").alias("a"), s["end"].cast("int").alias("b"))))
        empty = F.array().cast("array<struct<a:int,b:int>>")
        last = lambda out: F.element_at(out, -1)
        join = lambda out, s: F.when((F.size(out) > 0) & (s["a"] <= F.try_element_at(out, F.lit(-1))["b"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last(out)["a"].alias("a"), F.greatest(last(out)["b"], s["b"]).alias("b"))))).otherwise(F.concat(out, F.array(s)))
        return F.aggregate(sorted_, empty, join)

    total = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["b"] - s["a"])
    rows = rows.select(key, pieces(predicted).alias("p"), pieces(gold).alias("g"))
    both = F.aggregate(F.flatten(F.transform("p", lambda x: F.transform(F.col("g"), lambda y: F.greatest(F.lit(0), F.least(x["b"], y["b"]) - F.greatest(x["a"], y["a"]))))), F.lit(0), lambda n, x: n + x)
    rows = rows.select(key, total(F.col("p")).alias("n_p"), total(F.col("g")).alias("n_g"), both.alias("both"))
    rate = lambda of, other: F.when(F.col(of) > 0, F.col("both") / F.col(of)).when(F.col(other) == 0, 1.0).otherwise(0.0)
    rows = rows.withColumns({"precision": rate("n_p", "n_g"), "recall": rate("n_g", "n_p")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rows.select(key, F.round("precision", 4).alias("span_precision"), F.round("recall", 4).alias("span_recall"), F.round(f1, 4).alias("span_f1"))
