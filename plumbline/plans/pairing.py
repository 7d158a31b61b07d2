"""Queries from raw records to pairs.

Here documents stand for answers: each is the answer of a response whose
contexts are its source and language, and its spans come from ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import passages
from plumbline.operators import audit, pairs
from plumbline.operators.claims import SPLIT_SQL, split_claims
from plumbline.operators.evaluation import response_report
from plumbline.plans.answers import SPANS_SQL, STRIP_SQL, gold_spans
from plumbline.plans.registry import query
from plumbline.session import table

DOC_CLAIMS = SPLIT_SQL.format(src="(select doc_id k, text t from documents)").strip()
CONJUNCTION_SQL = "(regexp_matches(claim, '(?i)(^|[^\\p{L}\\p{N}_])(and|as well as|while|whereas)($|[^\\p{L}\\p{N}_])') or regexp_matches(claim, '以及|并且|同时|而且'))"


def span_arrays(spark, d) -> DataFrame:
    """doc_id and gold_spans of the documents that have any."""
    return gold_spans(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("span_start").cast("int").alias("start"), F.col("span_end").cast("int").alias("end"), F.lit(None).cast("string").alias("text"), "label_type"))).alias("gold_spans"))


def document_responses(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").join(span_arrays(spark, d), "doc_id", "left")
    context = lambda name, c: F.struct(F.lit(name).alias("id"), F.concat(F.lit(f"{name} "), F.coalesce(F.col(c), F.lit("none"))).alias("text"))
    return docs.select(F.col("doc_id").cast("string").alias("qid"), F.col("text").alias("answer"), F.array(context("source", "source"), context("lang", "lang")).alias("contexts"), "gold_spans", "source", F.col("lang").alias("split"))


@query("with " + DOC_CLAIMS + f"""
select k doc_id, count(*) claims, cast(sum(token_count) as bigint) tokens, max(token_count) most_tokens, cast(count(*) filter (token_count > 80) as bigint) long_claims, cast(count(*) filter (token_count >= 40 and {CONJUNCTION_SQL}) as bigint) compound_claims,
 cast(count(*) filter (regexp_matches(lead, '[0-9]')) as bigint) numbered, cast(count(*) filter (regexp_matches(lead, '[-*•]')) as bigint) bulleted from claims group by k""")
def claim_token_stats(spark, d):
    claims = split_claims(table(spark, d, "documents"), "doc_id", "text")
    has = lambda c, x: F.count_if(F.array_contains(c, x))
    return claims.groupBy("doc_id").agg(
        F.count("*").alias("claims"), F.sum("token_count").cast("long").alias("tokens"), F.max("token_count").alias("most_tokens"), has("review_reasons", "long_claim").alias("long_claims"), has("review_reasons", "possible_compound_claim").alias("compound_claims"),
        has("features", "numbered_list_item").alias("numbered"), has("features", "bullet_list_item").alias("bulleted"),
    )


@query("with " + DOC_CLAIMS + "," + SPANS_SQL + f""",
o as (select k, claim_no, label_type, span_start, greatest(claim_start, span_start) a, least(claim_end, span_end) b, claim_start, claim_end, span_end - span_start span_chars from claims join spans on doc_id = k where span_start < claim_end and claim_start < span_end),
p as (select *, round((b - a)::double / (claim_end - claim_start), 6) < 0.2 low, round((b - a)::double / span_chars, 6) < 0.5 cut, (a = claim_start or b = claim_end) and b - a <= 3 edge, b - greatest(a, coalesce(max(b) over (partition by k, claim_no order by a, b rows between unbounded preceding and 1 preceding), a)) fresh from o),
g as (select k, claim_no, count(*) n, bool_or(label_type like '% Conflict') cf, bool_or(label_type like '% Baseless Info') bl, string_agg(distinct label_type, ',' order by label_type) raw, cast(sum(greatest(fresh, 0)) as integer) chars,
  list(case when low then 'low_claim_overlap' end order by span_start) l1, list(case when cut then 'span_split_across_claims' end order by span_start) l2, list(case when edge then 'boundary_only_overlap' end order by span_start) l3 from p group by k, claim_no),
r as (select c.*, coalesce(cf, false) cf, coalesce(bl, false) bl, coalesce(n, 0) n, coalesce(raw, '') raw, coalesce(chars, 0) chars,
  list_concat([case when token_count > 80 then 'long_claim' end, case when token_count >= 40 and {CONJUNCTION_SQL} then 'possible_compound_claim' end, case when cf and bl then 'mixed_gold_types' end, case when n > 1 then 'multiple_gold_spans' end],
   [l1[1], l2[1], l3[1], l1[2], l2[2], l3[2]]) reasons from claims c left join g on c.k = g.k and c.claim_no = g.claim_no),
u as (select *, [x for x, i in reasons if x is not null and list_position(reasons, x) = i] told from r)
select k || '_c' || case when claim_no < 10 then '0' else '' end || claim_no pair_id, claim_start, claim_end, token_count claim_token_count, case when cf then 'conflict' when bl then 'unsupported' else 'supported' end gold_label, raw gold_label_raw, chars gold_overlap_char_count,
 round(chars::double / (claim_end - claim_start), 6) gold_claim_coverage_ratio, len(told) > 0 review_flag, coalesce(array_to_string(told, ','), '') review_reasons, sha256('[Evidence source]' || chr(10) || 'source ' || coalesce(source, 'none') || chr(10) || chr(10) || '[Evidence lang]' || chr(10) || 'lang ' || coalesce(lang, 'none')) document_sha256,
 'source,lang' document_ids, case when regexp_matches(lead, '[0-9]') then 'numbered_list_item' when regexp_matches(lead, '[-*•]') then 'bullet_list_item' else '' end split_features from u join documents on doc_id = k""")
def pair_table(spark, d):
    rows = pairs.response_pairs(document_responses(spark, d))
    text = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("pair_id", "claim_start", "claim_end", "claim_token_count", "gold_label", text("gold_label_raw"), "gold_overlap_char_count", "gold_claim_coverage_ratio", "review_flag", text("review_reasons"), F.sha2("document", 256).alias("document_sha256"), text("document_ids"), text("split_features"))


@query(f"""with t as (select doc_id, {STRIP_SQL.format(t="coalesce(lang, '')")} a, {STRIP_SQL.format(t="coalesce(text, '')")} b from documents)
select doc_id, 'passage_1' id, cast(length(a) as integer) chars, sha256(a) text_sha256 from t where a <> '' union all select doc_id, 'passage_2', cast(length(b) as integer), sha256(b) from t where b <> ''""")
def passage_split(spark, d):
    text = F.concat(F.lit("Passage 1: "), F.coalesce("lang", F.lit("")), F.lit("\n\npassage  2 :\n"), F.coalesce("text", F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", F.inline(passages(text)))
    return rows.select("doc_id", "id", F.char_length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def raw_records(spark, d) -> tuple[DataFrame, DataFrame]:
    """Raw responses and sources as they come before preparation; each source comes twice, and the later counts."""
    docs = table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("QA", "Summary", "Data2txt"))), (F.col("doc_id") % 3 + 1).cast("int"))
    info = F.named_struct(F.lit("question"), F.concat(F.lit("what of "), F.col("doc_id")), F.lit("passages"), F.concat(F.lit("passage 1: "), F.coalesce("lang", F.lit("")), F.lit("\npassage 2: "), F.coalesce("text", F.lit(""))), F.lit("text"), F.coalesce("text", F.lit("")))
    sources = docs.select(F.col("doc_id").alias("source_id"), kind.alias("task_type"), F.explode(F.array(F.lit("old"), F.lit("new"))).alias("source"), F.concat(F.lit("sum up "), F.col("doc_id")).alias("prompt"), info.alias("source_info"))
    labels = table(spark, d, "labels").join(span_arrays(spark, d), "doc_id", "left")
    responses = labels.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("source_id"), F.concat(F.lit("m"), F.col("doc_id") % 4).alias("model"), F.lit(0.5).alias("temperature"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("quality"), F.concat(F.lit("answer "), F.col("doc_id")).alias("response"), F.coalesce("gold_spans", F.array().cast(f"array<{pairs.SPAN}>")).alias("labels"),
    )
    return responses, sources.withColumn("version", F.col("source") == "new")


@query(f"""with s as (select *, ['QA', 'Summary', 'Data2txt'][doc_id % 3 + 1] task_type from documents), t as (select *, {STRIP_SQL.format(t="coalesce(lang, '')")} a, {STRIP_SQL.format(t="coalesce(text, '')")} b from s)
select cast(t.doc_id as varchar) qid, task_type, 'new' source, case when task_type = 'QA' then 'what of ' || t.doc_id else 'sum up ' || t.doc_id end query, case when task_type <> 'QA' then 'source_context' else concat_ws(',', case when a <> '' then 'passage_1' end, case when b <> '' then 'passage_2' end) end context_ids,
 cast(case when task_type <> 'QA' then length(coalesce(text, '')) else length(a) + length(b) end as bigint) context_chars, 'm' || (t.doc_id % 4) generator_model, toxic = 1 and length(text) > 0 gold_hallucinated from t join labels using (doc_id) where quality = 1 and doc_id % 2 = 1""")
def prepared_responses(spark, d):
    responses, sources = raw_records(spark, d)
    rows = pairs.converted(pairs.filtered_responses(responses, sources, task_type="all", split="test", order="version"))
    chars = F.aggregate("contexts", F.lit(0).cast("long"), lambda n, c: n + F.char_length(c["text"]))
    return rows.select("qid", "task_type", "source", "query", F.array_join(F.transform("contexts", lambda c: c["id"]), ",").alias("context_ids"), chars.alias("context_chars"), "generator_model", "gold_hallucinated")


PREDICTED_SQL = """pred as (select doc_id, 0 s, cast(least(90, n_chars) as integer) e from documents where doc_id % 3 = 0 and n_chars > 0 union all select doc_id, 50, cast(least(150, n_chars) as integer) from documents where doc_id % 2 = 0 and n_chars > 50)"""


def predicted_spans(spark, d) -> DataFrame:
    n = F.col("n_chars")
    kinds = F.array_compact(F.array(F.when((F.col("doc_id") % 3 == 0) & (n > 0), F.struct(F.lit(0).alias("start"), F.least(F.lit(90), n).cast("int").alias("end"))), F.when((F.col("doc_id") % 2 == 0) & (n > 50), F.struct(F.lit(50).alias("start"), F.least(F.lit(150), n).cast("int").alias("end")))))
    return table(spark, d, "documents").select("doc_id", "lang", kinds.alias("predicted_spans"))


@query("with " + SPANS_SQL.strip() + f""", {PREDICTED_SQL},
gp as (select distinct doc_id, unnest(range(span_start, span_end)) c from spans), pp as (select distinct doc_id, unnest(range(s, e)) c from pred),
n as (select doc_id, (select count(*) from gp where gp.doc_id = d.doc_id) g, (select count(*) from pp where pp.doc_id = d.doc_id) p, (select count(*) from gp join pp on gp.doc_id = pp.doc_id and gp.c = pp.c where gp.doc_id = d.doc_id) b from documents d),
r as (select doc_id, case when p > 0 then b::double / p when g = 0 then 1.0 else 0.0 end pr, case when g > 0 then b::double / g when p = 0 then 1.0 else 0.0 end re from n)
select doc_id, round(pr, 4) span_precision, round(re, 4) span_recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0.0 end, 4) span_f1 from r""")
def span_scores(spark, d):
    rows = predicted_spans(spark, d).join(span_arrays(spark, d), "doc_id", "left")
    return pairs.span_scores(rows, "doc_id")


@query("with " + SPANS_SQL.strip() + f""", {PREDICTED_SQL},
gp as (select distinct doc_id, unnest(range(span_start, span_end)) c from spans), pp as (select distinct doc_id, unnest(range(s, e)) c from pred),
r as (select doc_id, coalesce(lang, 'unknown') model, doc_id in (select doc_id from spans) gold, doc_id in (select doc_id from pred) said from documents),
n as (select count(*)::double samples, count(*) filter (gold and said)::double tp, count(*) filter (not gold and said)::double fp, count(*) filter (gold and not said)::double fn, count(*) filter (not gold and not said)::double tn from r),
c as (select (select count(*) from pp)::double p, (select count(*) from gp)::double g, (select count(*) from gp join pp using (doc_id, c))::double s),
m as (select model, count(*)::double samples, count(*) filter (gold)::double gold_hallucinated, count(*) filter (said)::double predicted_hallucinated, count(*) filter (gold = said)::double correct from r group by model)
select 'response' part, unnest(['samples', 'tp', 'fp', 'fn', 'tn', 'precision', 'recall', 'f1', 'accuracy']) as name, unnest([samples, tp, fp, fn, tn, round(tp / (tp + fp), 4), round(tp / (tp + fn), 4), round(2 * tp / (2 * tp + fp + fn), 4), round((tp + tn) / samples, 4)]) as value from n
union all select 'span', unnest(['precision', 'recall', 'f1']), unnest([round(s / p, 4), round(s / g, 4), round(2 * s / (p + g), 4)]) from c
union all select 'gold_span_type', label_type, count(*)::double from spans group by label_type
union all select 'pred_label', l, count(*)::double from (select case when said then 'unsupported' else 'supported' end l from r) x group by l
union all select 'model', model || '.' || unnest(['samples', 'gold_hallucinated', 'predicted_hallucinated', 'correct', 'accuracy']), unnest([samples, gold_hallucinated, predicted_hallucinated, correct, round(correct / samples, 4)]) from m""")
def response_evaluation(spark, d):
    rows = predicted_spans(spark, d).join(span_arrays(spark, d), "doc_id", "left")
    said, gold = F.size("predicted_spans") > 0, F.coalesce(F.size("gold_spans"), F.lit(0)) > 0
    rows = rows.select(F.col("doc_id").alias("qid"), F.col("lang").alias("generator_model"), gold.alias("gold_hallucinated"), said.alias("predicted_hallucinated"), "predicted_spans", "gold_spans", F.array(F.when(said, "unsupported").otherwise("supported")).alias("pred_labels"))
    return response_report(rows)


@query("with " + SPANS_SQL + """,
c as (select source, doc_id from documents where doc_id in (select doc_id from spans where contains(label_type, 'Conflict'))),
h as (select source, count(*) have from c group by source), w as (select source, count(*) want from documents join labels using (doc_id) where toxic = 1 and doc_id % 97 <> 0 group by source)
select 'count' as rule, coalesce(source, 'null') || ': ' || coalesce(have, 0) || ' of ' || coalesce(want, 0) as key from h full join w using (source) where coalesce(have, 0) <> coalesce(want, 0)""")
def challenge_counts(spark, d):
    """The challenge set by source against the counts of labels that lost some documents."""
    known = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("toxic = 1"), "doc_id").where("doc_id % 97 <> 0")
    expected = known.groupBy("source").agg(F.count("*").alias("n"))
    return audit.count_violations(audit.challenge(document_responses(spark, d)), "source", expected)
