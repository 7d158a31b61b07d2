"""Queries over answers (assistant turns), their statements and their contexts.

``responses`` are assistant turns with the turn before as the query;
``contexts`` of a conversation are all documents whose id falls on it;
``spans`` stand for annotated spans, taken from ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import ABSTENTION_PATTERNS, ENGLISH_STOPWORDS, NEGATIVE_WORDS, STOPWORDS, evidence_document, has_negative, light_token_count, strip, terms, words
from plumbline.operators import audit, checks, generation, ranking, spans, verdicts
from plumbline.operators.chunks import LIMIT, chunked
from plumbline.operators.claims import SPLIT_SQL, split_claims
from plumbline.plans.registry import query
from plumbline.session import table

STRIP_SQL = "regexp_replace({t}, '^[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+|[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+$', '', 'g')"
NEGATIVE_SQL = "|".join(NEGATIVE_WORDS)
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOPWORDS + ENGLISH_STOPWORDS) + ")"


def responses(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("query", F.lag("text").over(w))
    return turns.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "conv_id", "query", F.col("text").alias("answer"))


def contexts(spark, d, **more) -> DataFrame:
    """All documents by conversation; ``more`` columns are computed before rows are dealt, so a text that only they need is not shuffled."""
    n = table(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("n"))  # one row
    docs = table(spark, d, "documents").crossJoin(F.broadcast(n)).withColumn("conv_id", F.col("doc_id") % F.col("n"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("doc_id"))
    return docs.withColumns(more).withColumn("pos", pos).select("conv_id", "pos", "doc_id", "text", *more)


def gold_spans(spark, d) -> DataFrame:
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    kinds = F.array(
        F.struct(F.lit(0).alias("span_start"), F.least(F.lit(120), "n_chars").cast("int").alias("span_end"), F.when(F.col("toxic") == 1, "Evident Conflict").alias("label_type")),
        F.struct(F.lit(60).alias("span_start"), F.least(F.lit(200), "n_chars").cast("int").alias("span_end"), F.when(F.col("quality") == 0, "Evident Baseless Info").alias("label_type")),
    )
    return both.select("doc_id", F.inline(kinds)).where("label_type is not null and span_start < span_end")


RESPONSES_SQL = """
turns as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) query from conversations),
responses as (select conv_id * 1000 + turn qid, conv_id, query, text answer from turns where role = 'assistant')"""
CONTEXTS_SQL = """
placed_docs as (select doc_id % (select count(distinct conv_id) from conversations) conv_id, doc_id, text from documents),
contexts as (select * from (select conv_id, cast(row_number() over (partition by conv_id order by doc_id) as integer) pos, doc_id, text from placed_docs) x)"""
SPANS_SQL = """
spans as (select doc_id, 0 span_start, cast(least(120, n_chars) as integer) span_end, 'Evident Conflict' label_type from labels join documents using (doc_id) where toxic = 1 and n_chars > 0
  union all select doc_id, 60, cast(least(200, n_chars) as integer), 'Evident Baseless Info' from labels join documents using (doc_id) where quality = 0 and n_chars > 60)"""
TERMS_SQL = "(select unnest(list_concat(regexp_extract_all({t}, '[一-鿿]'), regexp_extract_all(lower({t}), '[a-z0-9]+'))) term"


@query("with " + SPLIT_SQL.format(src="(select conv_id * 1000 + turn k, text t from conversations)").strip() + " select k qid, claim_no, claim, claim_start, claim_end, token_count from claims")
def claim_split(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return split_claims(turns, "qid", "text").select("qid", "claim_no", "claim", "claim_start", "claim_end", "token_count")


@query("with " + SPLIT_SQL.format(src="(select doc_id k, text t from documents)").strip() + " select k doc_id, claim_no, claim_start, claim_end, token_count from claims")
def document_claims(spark, d):
    return split_claims(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "claim_no", "claim_start", "claim_end", "token_count")


DOC_CLAIMS_SQL = SPLIT_SQL.format(src="(select doc_id k, text t from documents where doc_id in (select doc_id from labels))").strip()
OVERLAP_SQL = f"""{SPANS_SQL},
c as (select k doc_id, claim_no, claim_start, claim_end from claims),
o as (select c.*, span_start, span_end, label_type, least(claim_end, span_end) - greatest(claim_start, span_start) overlap_chars from c join spans using (doc_id) where span_start < claim_end and claim_start < span_end),
p as (select *, round(overlap_chars::double / (claim_end - claim_start), 6) cr, round(overlap_chars::double / (span_end - span_start), 6) sr, (greatest(claim_start, span_start) = claim_start or least(claim_end, span_end) = claim_end) tch from o)"""


def labelled_claims(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return split_claims(docs, "doc_id", "text").select("doc_id", "claim_no", "claim_start", "claim_end")


@query("with " + DOC_CLAIMS_SQL + "," + OVERLAP_SQL + """,
g as (select doc_id, claim_no, count(*) n, bool_or(label_type = 'Evident Conflict') cf, bool_or(label_type = 'Evident Baseless Info') bl, bool_or(cr < 0.2) low, bool_or(sr < 0.5) cut, bool_or(tch and overlap_chars <= 3) edge from p group by doc_id, claim_no)
select c.doc_id, c.claim_no, case when cf then 'conflict' when bl then 'unsupported' else 'supported' end gold_label, coalesce(n, 0) n_spans,
  concat_ws(',', case when cf and bl then 'mixed_gold_types' end, case when n > 1 then 'multiple_gold_spans' end, case when low then 'low_claim_overlap' end, case when cut then 'span_split_across_claims' end, case when edge then 'boundary_only_overlap' end) review_reasons
from c left join g on c.doc_id = g.doc_id and c.claim_no = g.claim_no""")
def gold_projection(spark, d):
    claims = labelled_claims(spark, d)
    found = spans.overlaps(claims, gold_spans(spark, d), "doc_id")
    return spans.projected(claims, found, ["doc_id", "claim_no"]).withColumn("review_reasons", F.array_join("review_reasons", ","))


@query("with " + DOC_CLAIMS_SQL + "," + OVERLAP_SQL + " select doc_id, claim_no, label_type, overlap_chars, cr claim_ratio, sr span_ratio, tch touches from p")
def span_overlaps(spark, d):
    found = spans.overlaps(labelled_claims(spark, d), gold_spans(spark, d), "doc_id")
    return found.select("doc_id", "claim_no", "label_type", "overlap_chars", "claim_ratio", "span_ratio", "touches")


@query("with " + SPANS_SQL.strip() + """,
m as (select *, max(span_end) over (partition by doc_id order by span_start, span_end rows between unbounded preceding and 1 preceding) reach from spans),
g as (select *, sum(case when reach is null or span_start > reach then 1 else 0 end) over (partition by doc_id order by span_start, span_end rows unbounded preceding) piece from m),
u as (select doc_id, piece, min(span_start) s, max(span_end) e from g group by doc_id, piece)
select doc_id, cast(sum(e - s) as bigint) chars, count(*) pieces from u group by doc_id""")
def span_union_coverage(spark, d):
    pieces = spans.union_pieces(gold_spans(spark, d), "doc_id")
    return pieces.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).cast("long").alias("chars"), F.count("*").alias("pieces"))


@query("with " + SPANS_SQL.strip() + """,
gold as (select doc_id, min(span_start) gs, max(span_end) ge from spans group by doc_id),
pred as (select doc_id, 0 ps, cast(least(90, n_chars) as integer) pe from documents where doc_id % 3 = 0 and n_chars > 0),
t as (select (select sum(ge - gs) from gold) g, (select sum(pe - ps) from pred) p, (select sum(least(ge, pe) - greatest(gs, ps)) from gold join pred using (doc_id) where gs < pe and ps < ge) s)
select cast(g as bigint) gold_chars, cast(p as bigint) pred_chars, cast(s as bigint) shared, s::double / p span_precision, s::double / g span_recall, 2.0 * s / (g + p) span_f1 from t""")
def span_micro_f1(spark, d):
    gold = spans.union_pieces(gold_spans(spark, d), "doc_id")
    docs = table(spark, d, "documents").where("doc_id % 3 = 0 and n_chars > 0")
    pred = docs.select("doc_id", F.lit(0).alias("span_start"), F.least(F.lit(90), "n_chars").cast("int").alias("span_end"))
    sums = [spans.covered_chars(x, "doc_id").agg(F.sum("chars").alias(n)) for x, n in ((gold, "g"), (pred, "p"))]
    parts = [*(s.select(F.lit(n).alias("what"), F.col(n).cast("long").alias("v")) for s, n in zip(sums, ("g", "p"))), spans.shared_chars(gold, pred, "doc_id").agg(F.sum("shared").cast("long").alias("v")).select(F.lit("s").alias("what"), "v")]
    g, p, s = (F.sum(F.when(F.col("what") == x, F.col("v")).otherwise(0)) for x in "gps")
    return checks.union(parts).agg(g.alias("gold_chars"), p.alias("pred_chars"), s.alias("shared")).withColumns({"span_precision": spans.ratio(F.col("shared"), F.col("pred_chars")), "span_recall": spans.ratio(F.col("shared"), F.col("gold_chars")), "span_f1": spans.ratio(2 * F.col("shared"), F.col("gold_chars") + F.col("pred_chars"))})


@query(f"""select doc_id, cast(len(regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]')) as integer) light_tokens,
 (select count(*) from {TERMS_SQL.format(t='d.text')}) x where term not in {STOP_SQL}) terms, (select count(distinct term) from {TERMS_SQL.format(t='d.text')}) x where term not in {STOP_SQL}) distinct_terms,
 cast(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as bigint) words from documents d""")
def token_counts_by_tokenizer(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", light_token_count(t).alias("light_tokens"), F.size(terms(t)).cast("long").alias("terms"), F.size(F.array_distinct(terms(t))).cast("long").alias("distinct_terms"), F.size(words(t)).cast("long").alias("words"))


def _bm25_sql(tokens: str, stop: str, numerator: float, k1: float, distinct: bool, floor: str, by: str) -> str:
    times = "1" if distinct else "count(*)"
    return f"""with {RESPONSES_SQL.strip()}, {CONTEXTS_SQL.strip()},
ct as (select conv_id, pos, unnest({tokens.format(t='text')}) term from contexts), ctf as (select * from ct {stop}),
tf as (select conv_id, pos, term, count(*) tf from ctf group by conv_id, pos, term), df as (select conv_id, term, count(*) df from tf group by conv_id, term),
dl as (select c.conv_id, c.pos, coalesce(x.dl, 0) dl from contexts c left join (select conv_id, pos, count(*) dl from ctf group by conv_id, pos) x on c.conv_id = x.conv_id and c.pos = x.pos),
sz as (select conv_id, count(*) n, greatest(avg(dl), {floor}) avgdl from dl group by conv_id),
qt as (select qid, conv_id, unnest({tokens.format(t='query')}) term from responses), qn as (select qid, conv_id, term, {times} times from (select * from qt {stop}) x group by qid, conv_id, term),
sc as (select q.qid, t.pos, count(*) overlap, sum(q.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {numerator} / (tf + {k1} * (0.25 + 0.75 * dl.dl / avgdl))) score
  from qn q join tf t on q.conv_id = t.conv_id and q.term = t.term join df on df.conv_id = q.conv_id and df.term = q.term join sz on sz.conv_id = q.conv_id join dl on dl.conv_id = t.conv_id and dl.pos = t.pos group by q.qid, t.pos),
scored as (select r.qid, dl.pos, coalesce(overlap, 0) overlap, round(coalesce(score, 0), 4) score, round(coalesce(score, 0), 9) full_score from responses r join dl on dl.conv_id = r.conv_id left join sc on sc.qid = r.qid and sc.pos = dl.pos),
ranked as (select *, cast(row_number() over (partition by qid order by {by} desc, pos) as integer) rank from scored)"""


TOKENS_A_SQL = "list_concat(regexp_extract_all({t}, '[一-鿿]'), regexp_extract_all(lower({t}), '[a-z0-9]+'))"
RETRIEVAL_SQL = _bm25_sql(TOKENS_A_SQL, f"where term not in {STOP_SQL}", 2.0, 1.2, False, "1", "score")
SELECTION_SQL = _bm25_sql("regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')", "", 2.5, 1.5, True, "1", "full_score")


def retrieval(spark, d, pool):
    return ranking.ranked(ranking.bm25(responses(spark, d), pool(spark, d), terms, group="conv_id", numerator=2.0, k1=1.2, distinct_terms=False, digits=4))


def selection(spark, d, pool):
    return ranking.ranked(ranking.bm25(responses(spark, d), pool(spark, d), words, group="conv_id", numerator=2.5, k1=1.5, distinct_terms=True, digits=9))


@query(RETRIEVAL_SQL + " select qid, pos, score, rank from ranked")
def bm25_retrieval(spark, d, pool=contexts):
    return retrieval(spark, d, pool).select("qid", "pos", "score", "rank")


@query(SELECTION_SQL + " select qid, pos, score, rank from ranked")
def bm25_selection(spark, d, pool=contexts):
    return selection(spark, d, pool).select("qid", "pos", F.round("score", 4).alias("score"), "rank")


@query(SELECTION_SQL + " select qid, k, pos, rank, cast(row_number() over (partition by qid, k order by pos) as integer) source_order from ranked, (select unnest([1, 3, 5]) k) ks where rank <= k")
def topk_source_order(spark, d, pool=contexts):
    return ranking.top_k(selection(spark, d, pool)).select("qid", "k", "pos", "rank", "source_order")


@query(RETRIEVAL_SQL + " select qid, pos, cast(row_number() over (partition by qid order by rank) as integer) kept_rank from ranked where overlap > 0 or rank = 1 qualify row_number() over (partition by qid order by rank) <= 2")
def evidence_filter_topk(spark, d, pool=contexts):
    return ranking.evidence_filter(retrieval(spark, d, pool), F.col("overlap"), 2).select("qid", "pos", "kept_rank")


RULE_SQL = f"""with {RESPONSES_SQL.strip()}, {CONTEXTS_SQL.strip()}, {SPLIT_SQL.format(src="(select qid k, answer t from responses)").strip()},
cl as (select k qid, claim_no, claim, cast(floor(k / 1000) as bigint) conv_id from claims),
ct as (select distinct qid, claim_no, conv_id, term from (select qid, claim_no, conv_id, unnest({TOKENS_A_SQL.format(t='claim')}) term from cl) x where term not in {STOP_SQL}),
ot as (select distinct conv_id, pos, term from (select conv_id, pos, unnest({TOKENS_A_SQL.format(t='text')}) term from contexts) x where term not in {STOP_SQL}),
ov as (select qid, claim_no, pos, count(*) overlap from ct join ot using (conv_id, term) group by qid, claim_no, pos),
nt as (select qid, claim_no, count(*) n_terms from ct group by qid, claim_no),
sc as (select cl.qid, cl.claim_no, cl.claim, c.pos, c.text, coalesce(overlap, 0) overlap, coalesce(n_terms, 0) n_terms, row_number() over (partition by cl.qid, cl.claim_no order by coalesce(overlap, 0) desc, c.pos) r
  from cl left join contexts c on c.conv_id = cl.conv_id left join ov on ov.qid = cl.qid and ov.claim_no = cl.claim_no and ov.pos = c.pos left join nt on nt.qid = cl.qid and nt.claim_no = cl.claim_no),
v as (select qid, claim_no, pos, cast(overlap as bigint) overlap, case when pos is null then 'unsupported' when regexp_matches(lower(claim), '{"|".join(ABSTENTION_PATTERNS)}') then 'supported' when overlap = 0 or overlap::double / greatest(n_terms, 1) < 0.2 then 'unsupported'
  when regexp_matches(claim, '{NEGATIVE_SQL}') <> regexp_matches(text, '{NEGATIVE_SQL}') then 'conflict' else 'supported' end as label from sc where r = 1)"""


def _verdicts(spark, d, pool):
    answers = responses(spark, d)
    claims = split_claims(answers, "qid", "answer").withColumn("conv_id", F.floor(F.col("qid") / 1000).cast("long"))
    claims = claims.withColumn("claim_id", F.struct("qid", "claim_no"))
    return verdicts.rule_verdicts(claims, pool(spark, d), "conv_id")


@query(RULE_SQL + " select qid, claim_no, pos, overlap, label from v")
def rule_verdicts(spark, d, pool=contexts):
    return _verdicts(spark, d, pool).select(F.col("claim_id.qid").alias("qid"), F.col("claim_id.claim_no").alias("claim_no"), "pos", F.col("overlap").cast("long").alias("overlap"), "label")


@query(RULE_SQL + " select qid, count(*) claims, cast(count(*) filter (where label = 'supported') as bigint) supported, count(*) filter (where label = 'supported')::double / count(*) faithfulness, bool_or(label <> 'supported') hallucinated from v group by qid")
def response_metrics(spark, d, pool=contexts):
    rows = rule_verdicts(spark, d, pool)
    good = F.count_if(F.col("label") == "supported")
    return rows.groupBy("qid").agg(F.count("*").alias("claims"), good.alias("supported"), spans.ratio(good, F.count("*")).alias("faithfulness"), F.max(F.col("label") != "supported").alias("hallucinated"))


@query("select doc_id, cast(row_number() over (order by ('0x' || substr(sha256('7:' || doc_id), 1, 13))::bigint, doc_id) as integer) drawn from documents qualify drawn <= 100")
def seeded_sample_topn(spark, d):
    return ranking.exact_sample(table(spark, d, "documents"), "doc_id", 100, 7).select("doc_id", "drawn")


@query(f"with {RESPONSES_SQL.strip()}, {CONTEXTS_SQL.strip()}, p as (select conv_id, string_agg('[Evidence ' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) order by pos) document from contexts group by conv_id) select qid, sha256(document) document_sha256, cast(length(document) as bigint) document_chars from responses join p using (conv_id)")
def document_build(spark, d, pool=contexts):
    rows = pool(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("doc_id").cast("string").alias("id"), "text"))).alias("cs"))  # as many as fall on a conversation
    built = rows.select("conv_id", evidence_document(F.col("cs")).alias("doc"))
    return responses(spark, d).join(built, "conv_id").select("qid", F.sha2("doc", 256).alias("document_sha256"), F.char_length("doc").cast("long").alias("document_chars"))


@query(f"""with {RESPONSES_SQL.strip()}, a as (select qid, term, count(*) n from (select qid, unnest({TOKENS_A_SQL.format(t='answer')}) term from responses) x where term not in {STOP_SQL} group by qid, term),
q as (select qid, term, count(*) n from (select qid, unnest({TOKENS_A_SQL.format(t='query')}) term from responses) x where term not in {STOP_SQL} group by qid, term),
s as (select a.qid, sum(least(a.n, q.n)) shared from a join q on a.qid = q.qid and a.term = q.term group by a.qid), ta as (select qid, sum(n) n from a group by qid), tq as (select qid, sum(n) n from q group by qid)
select r.qid, cast(coalesce(shared, 0) as bigint) shared, case when coalesce(ta.n, 0) + coalesce(tq.n, 0) = 0 then 0.0 else 2.0 * coalesce(shared, 0) / (coalesce(ta.n, 0) + coalesce(tq.n, 0)) end token_f1 from responses r left join s on s.qid = r.qid left join ta on ta.qid = r.qid left join tq on tq.qid = r.qid""")
def answer_token_f1(spark, d):
    return generation.token_f1(responses(spark, d), "qid", "answer", "query")


@query(f"""with stripped as (select doc_id, {STRIP_SQL.format(t="text")} text from documents) select doc_id, case when regexp_matches(text, '{audit.NONCLAIM}') or regexp_matches(text, '{audit.BOILERPLATE}') or ends_with(text, ':') then 'exclude_nonclaim'
 when regexp_matches(regexp_replace(text, '{audit.PREFACE}', ''), '{audit.SOURCE_RELATIVE}') then 'exclude_source_relative' else 'include' end as action, regexp_matches(text, '{audit.MISSING_REFERENT}') missing_referent from stripped""")
def audit_decisions(spark, d):
    action, _ = audit.proposal(F.col("text"), F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", action.alias("action"), strip(F.col("text")).rlike(audit.MISSING_REFERENT).alias("missing_referent"))


@query("""with p as (select doc_id, case when quality = 1 then 'supported' else 'unsupported' end gold from labels), dec as (select doc_id, case when doc_id % 5 = 0 then 'exclude' else 'include' end as action, gold from p), ov as (select doc_id, case when doc_id % 2 = 0 then 'include' else 'exclude' end as action, 'conflict' gold from p where doc_id % 10 in (0, 1))
select p.doc_id, coalesce(ov.gold, dec.gold, p.gold) gold from p join dec using (doc_id) left join ov using (doc_id) where coalesce(ov.action, dec.action) = 'include'""")
def audit_freeze(spark, d):
    pairs = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("gold"))
    decisions = pairs.withColumn("action", F.when(F.col("doc_id") % 5 == 0, "exclude").otherwise("include"))
    overrides = pairs.where("doc_id % 10 in (0, 1)").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "include").otherwise("exclude").alias("action"), F.lit("conflict").alias("gold"))
    return audit.frozen(pairs, decisions, overrides, "doc_id").select("doc_id", "gold")


#: White space as Python's regular expressions have it, within a class.
SPACE_SQL = r"\s\p{Z}\x0b\x1c-\x1f\x85"
#: Packed chunks of ``documents``: tokens with their places, sentences, those over the limit cut before words, and whole units walked over.
CHUNKS_SQL = r"""with recursive docs as (select doc_id, text from documents where text is not null),
found as (select doc_id, regexp_extract_all(text, '[@SPACE]*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_@SPACE])') whole from docs),
measured as (select doc_id, unnest([length(x) for x in whole]) l, unnest([length(regexp_replace(x, '^[@SPACE]+', '')) for x in whole]) size, generate_subscripts(whole, 1) i from found),
tokens as (select doc_id, i, cast(e - size as bigint) s, cast(e as bigint) e from (select *, sum(l) over (partition by doc_id order by i) e from measured)),
cut_texts as (select doc_id, string_split(regexp_replace(regexp_replace(replace(text, chr(1), '!'), '([.!?。！？])([@SPACE])', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)) xs from docs),
pieces as (select doc_id, unnest(xs) x, generate_subscripts(xs, 1) i from cut_texts),
placed as (select *, sum(length(x)) over (partition by doc_id order by i) e from pieces),
sentences as (select doc_id, cast(e - length(regexp_replace(x, '^[@SPACE]+', '')) as bigint) a, cast(e - length(x) + length(regexp_replace(x, '[@SPACE]+$', '')) as bigint) b from placed where regexp_matches(x, '[^@SPACE]')),
reached as (select x.*, f.s far from (select s.*, coalesce(t.i, 0) + @LIMIT - 1 beyond from sentences s asof left join tokens t on s.doc_id = t.doc_id and s.a >= t.e) x left join tokens f on x.doc_id = f.doc_id and x.beyond = f.i),
long as (select doc_id, a, b from reached where far < b),
word_runs as (select doc_id, unnest(regexp_extract_all(text, '[@SPACE]*[^@SPACE]+')) x, generate_subscripts(regexp_extract_all(text, '[@SPACE]*[^@SPACE]+'), 1) i from docs where doc_id in (select doc_id from long)),
words as (select doc_id, list(e - length(regexp_replace(x, '^[@SPACE]+', '')) order by i) words from (select *, sum(length(x)) over (partition by doc_id order by i) e from word_runs) group by doc_id),
rulers as (select w.doc_id, words, starts, ends from words w join (select doc_id, list(s order by i) starts, list(e order by i) ends from tokens where doc_id in (select doc_id from long) group by doc_id) t on w.doc_id = t.doc_id),
cuts as (select doc_id, a, b, a stop from long union all
  select doc_id, stop, b, case when coalesce(far, b) >= b then b when word > stop then word else greatest(far, stop + 1) end
  from (select *, list_max([w for w in words if w <= far]) word from (select c.doc_id, c.stop, c.b, r.words, r.starts[len([e for e in r.ends if e <= c.stop]) + @LIMIT - 1] far from cuts c join rulers r on c.doc_id = r.doc_id where c.stop < c.b))),
units as (select *, row_number() over (partition by doc_id order by a) no, count(*) over (partition by doc_id) n from (select doc_id, a, b from reached where far is null or far >= b union all select doc_id, a, stop from cuts where stop > a)),
fars as (select u.*, f.s far from (select u.*, coalesce(t.i, 0) before from units u asof left join tokens t on u.doc_id = t.doc_id and u.a >= t.e) u left join tokens f on u.doc_id = f.doc_id and u.before + @LIMIT - 1 = f.i),
lasts as (select f.doc_id, f.no, f.n, f.a, f.before, case when f.far is null then f.n else greatest(f.no, coalesce(u.no, 0)) end last from fars f asof left join units u on f.doc_id = u.doc_id and f.far >= u.b),
packed as (select doc_id, 0 chunk_no, no, n, a, before, last from lasts where no = 1 union all
  select p.doc_id, p.chunk_no + 1, l.no, l.n, l.a, l.before, l.last from packed p join lasts l on p.doc_id = l.doc_id and l.no = case when p.last = p.no then p.last + 1 else p.last end where p.last < p.n),
ended as (select p.*, u.b from packed p join units u on p.doc_id = u.doc_id and p.last = u.no)
select p.doc_id, cast(chunk_no as integer) chunk_no, cast(a as integer) start, cast(b as integer) "end", cast(2 + greatest(0, coalesce(t.i, 0) - before) as integer) token_count from ended p asof left join tokens t on p.doc_id = t.doc_id and p.b > t.s""".replace("@SPACE", SPACE_SQL)


@query(CHUNKS_SQL.replace("@LIMIT", str(LIMIT)))
def chunk_pack(spark, d):
    return chunked(table(spark, d, "documents"), "doc_id", "text").drop("text")


@query(f"""with s as (select doc_id, trim(unnest(regexp_split_to_array(text, '\\n+'))) line from documents), n as (select doc_id, count(*) lines, sum(case when regexp_matches(line, '{NEGATIVE_SQL}') then 1 else 0 end) negative_lines from s where line <> '' group by doc_id) select doc_id, lines, cast(negative_lines as bigint) negative_lines from n""")
def negation_by_line(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n+")).alias("line")).where("trim(line) <> ''")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(has_negative(F.col("line"))).alias("negative_lines"))


@query("with s as (select a.vec_id qv, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) score from embeddings a join embeddings b on a.vec_id <> b.vec_id) select qv, vec_id, score, cast(row_number() over (partition by qv order by score desc, vec_id) as integer) rank from s qualify rank <= 5")
def dense_rank_topk(spark, d):
    """Every vector's five nearest of the whole table."""
    return ranking.dense_topk(table(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query("""with q as (select vec_id qid, label grp, embedding::double[] v from embeddings where vec_id % 20 = 0), p as (select label grp, vec_id pos, embedding::double[] v from embeddings)
select qid, pos, round(list_cosine_similarity(q.v, p.v), 4) score, cast(row_number() over (partition by qid order by round(list_cosine_similarity(q.v, p.v), 4) desc, pos) as integer) rank from q join p using (grp)""")
def dense_pool_ranking(spark, d):
    """Every twentieth vector ranks the pool that its label names."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("pos"), "label", F.col("embedding").alias("vector"))
    return ranking.pool_ranking(rows.where("qid % 20 = 0"), rows, "label")
