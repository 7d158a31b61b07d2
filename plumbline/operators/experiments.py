"""Experiments on evidence: pools of chunks, chosen variants, orders, and annotated evidence.

A variant is a value in a column: all variants of an experiment are made and
judged in one job.  Rows of a pool are (``group``, pos, chunk_id, source_id,
start, end, text); a pool belongs to a response, whatever its statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import draw
from plumbline.operators import checks, digests
from plumbline.operators.chunks import SPECIALS, case_retention, chunked, retained
from plumbline.operators.quotes import quote_places

METHODS = ("random", "bm25", "dense")
KS = (1, 3, 5)
#: Fixed value: tokens of words and signs, as the stand-in tokenizer counts them.
TOKENS = "(?U)\\w+|[^\\w\\s]"


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKENS))


def pool(contexts: DataFrame, group: str, limit: int = 128) -> DataFrame:
    """The chunks of the contexts (``group``, pos, id, text) in source order."""
    keyed = contexts.select(F.struct(group, "pos", F.col("id").cast("string").alias("id")).alias("k"), "text")
    place = F.row_number().over(Window.partitionBy(group).orderBy("context", "chunk_no"))
    rows = chunked(keyed, "k", "text", limit).select(F.col(f"k.{group}").alias(group), F.col("k.pos").alias("context"), F.col("k.id").alias("source_id"), "chunk_no", "start", "end", "token_count", "text")
    number = F.lpad((F.col("chunk_no") + 1).cast("string"), F.greatest(F.lit(3), F.char_length((F.col("chunk_no") + 1).cast("string"))), F.lit("0"))
    return rows.select(group, place.alias("pos"), F.concat("source_id", F.lit("_c"), number).alias("chunk_id"), "source_id", "context", "start", "end", "token_count", "text")


def pool_violations(chunks: DataFrame, contexts: DataFrame, group: str) -> DataFrame:
    """Chunk ids that repeat, offsets that do not give the chunk's text, and places out of source order."""
    keyed = chunks.withColumn("key", F.concat_ws("/", F.col(group).cast("string"), "chunk_id"))
    told = keyed.join(contexts.select(group, F.col("id").cast("string").alias("source_id"), F.col("text").alias("source_text")), [group, "source_id"], "left")
    here = F.struct("context", "start", "end")
    told = told.withColumn("before", F.lag(here).over(Window.partitionBy(group).orderBy("pos"))).withColumn("here", here)
    rules = {
        "unknown_source": F.col("source_text").isNull(), "offsets": (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.char_length("source_text")),
        "text": F.substr(F.col("source_text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"), "order": F.coalesce(F.col("before") > F.col("here"), F.lit(False)),
    }
    rules["offsets"], rules["text"] = (F.coalesce(rules[x], F.lit(False)) for x in ("offsets", "text"))
    return checks.duplicates(keyed, "key").unionByName(checks.violations(told, "key", rules))


def random_scores(candidates: DataFrame, seed: int) -> DataFrame:
    """``qid``, ``pos`` and a score that seed, query and place alone decide."""
    return candidates.select("qid", "pos", draw(seed, F.col("qid"), F.col("pos")).alias("score"))


def evidence_text(chunks: Column) -> Column:
    """(chunk_id, text) chunks as one document."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("[Evidence "), c["chunk_id"], F.lit("]\n"), c["text"])), "\n\n")


def chunk_cost(chunk_id: Column, text: Column) -> Column:
    """Tokens that a chunk adds to a document, with its header."""
    return tokens_of(F.concat(F.lit("[Evidence "), chunk_id, F.lit("]\n"), text))


def budget_choice(scored: DataFrame, budget: int = 512, k: int = 3) -> DataFrame:
    """Greedy choice in rank order under a budget of the whole document and the claim, by (qid, variant).

    ``scored`` has qid, variant, pos, score, cost (``chunk_cost``) and
    claim_tokens.  What does not fit is skipped and smaller chunks are tried on.
    A query that nothing fits, or with a score that is no number, has status
    ``nothing_fits`` or ``bad_score`` and chooses nothing.  ``scores`` that tie go
    by place.
    """
    row = F.struct((-F.col("score")).alias("s"), F.col("pos").cast("long").alias("pos"), F.col("cost").cast("long").alias("cost"))
    bad = F.max(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == F.lit(float("inf"))))
    pools = scored.groupBy("qid", "variant").agg(F.array_sort(F.collect_list(row)).alias("pool"), (F.max("claim_tokens") + SPECIALS).cast("long").alias("fixed"), bad.alias("bad"), F.count("*").alias("candidates"))
    start = F.struct(F.col("fixed").alias("used"), F.array().cast("array<bigint>").alias("chosen"))
    fits = lambda s, x: (s["used"] + x["cost"] <= budget) & (F.size(s["chosen"]) < k)
    step = lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["chosen"], F.array(x["pos"])).alias("chosen"))).otherwise(s)
    rows = pools.withColumn("s", F.aggregate("pool", start, step))
    status = F.when(F.col("bad"), "bad_score").when(F.size("s.chosen") == 0, "nothing_fits").otherwise("ok")
    chosen = F.when(F.col("bad"), F.array().cast("array<bigint>")).otherwise(F.col("s.chosen"))
    return rows.select("qid", "variant", "candidates", F.col("s.used").alias("input_tokens"), chosen.alias("chosen"), status.alias("status"))


def chosen_chunks(choices: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each chosen chunk, with ``place`` in the order of the choice and ``source_order`` in that of the pool."""
    each = choices.select("qid", "variant", F.posexplode("chosen").alias("place", "pos"))
    rows = each.join(candidates, ["qid", "pos"])
    return rows.withColumn("source_order", F.row_number().over(Window.partitionBy("qid", "variant").orderBy("pos"))).withColumn("place", F.col("place") + 1)


def assembled(chunks: DataFrame, order: str) -> DataFrame:
    """``document``, its ids and its tokens for each (qid, variant), its chunks in the order of a column."""
    rows = chunks.groupBy("qid", "variant").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "chunk_id", "text"))).alias("cs"))
    return rows.select("qid", "variant", evidence_text(F.col("cs")).alias("document"), F.transform("cs", lambda c: c["chunk_id"]).alias("document_ids"), F.aggregate("cs", F.lit(0), lambda n, c: n + chunk_cost(c["chunk_id"], c["text"])).alias("document_tokens"))


def both_orders(chunks: DataFrame) -> DataFrame:
    """Each choice assembled by rank and by source; the same chunks, and whether the order differs."""
    rank, source = (assembled(chunks, o).withColumnsRenamed({"document": f"{n}_document", "document_ids": f"{n}_ids", "document_tokens": f"{n}_tokens"}) for o, n in (("place", "rank"), ("source_order", "source")))
    return rank.join(source, ["qid", "variant"]).withColumn("order_changed", F.col("rank_ids") != F.col("source_ids"))


def k_sweep(ranked: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """The first k of each ranking (qid, variant, pos, rank) for all ks at once, in source order.

    ``actual_k`` falls short of ``requested_k`` where there are fewer candidates.
    """
    sizes = Window.partitionBy("qid", "variant")
    cut = ranked.withColumn("candidates", F.count("*").over(sizes)).withColumn("requested_k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= requested_k")
    rows = cut.groupBy("qid", "variant", "requested_k").agg(F.first("candidates").alias("candidate_count"), F.array_sort(F.collect_list("pos")).alias("selected"))
    return rows.select("qid", F.concat("variant", F.lit("_k"), "requested_k").alias("variant"), "requested_k", "candidate_count", F.size("selected").alias("actual_k"), (F.col("candidate_count") < F.col("requested_k")).alias("candidate_shortfall"), "selected")


def sweep_comparisons(methods: tuple[str, ...] = METHODS, ks: tuple[int, ...] = KS, across: tuple[str, str] = ("bm25", "dense")) -> list[tuple[str, str]]:
    """Which variants of a sweep are set against which: along k within a method, two methods at each k, and the full ones."""
    a, b, c = ks
    within = [(f"{m}_k{x}", f"{m}_k{y}") for m in methods for x, y in ((a, b), (b, c), (a, c))]
    return [*within, *((f"{across[0]}_k{k}", f"{across[1]}_k{k}") for k in ks), ("full_source", "full_chunked_source")]


def check_rebuilt(stored: DataFrame, rebuilt: DataFrame, key: list[str], columns: list[str]) -> None:
    """Raise with some rows if what is stored is not what its inputs give again; of equal tables only digests meet."""
    found = digests.changes(stored, rebuilt, key, columns).orderBy(*key).take(5)
    if found:
        raise ValueError("stored and rebuilt differ: " + "; ".join(f"{'/'.join(str(r[k]) for k in key)} {r['change']}" for r in found))


def pool_scores(scores: DataFrame, chunks: DataFrame, group: str, pairs: DataFrame) -> DataFrame:
    """A score for every chunk of every pair's pool (qid, pos, score) from an outside ranker's rows (qid, chunk_id, score).

    A pool's chunk without a score, one that is scored twice, and scores of
    chunks that the pool has not raise: a ranking may not be of part of a pool.
    """
    pool = pairs.select("qid", group).join(chunks.select(group, "pos", "chunk_id"), group).select("qid", "pos", "chunk_id")
    told = scores.groupBy("qid", "chunk_id").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    both = pool.join(told, ["qid", "chunk_id"], "full").withColumn("key", F.concat_ws("/", F.col("qid").cast("string"), "chunk_id"))
    rules = {"not_in_pool": F.col("pos").isNull(), "not_scored": F.col("n").isNull(), "scored_twice": F.coalesce(F.col("n") > 1, F.lit(False)), "no_number": F.col("n").isNotNull() & (F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))}
    checks.enforce(checks.violations(both, "key", rules))
    return both.select("qid", "pos", "score")


def annotated_spans(annotations: DataFrame, contexts: DataFrame, group: str) -> DataFrame:
    """Every place of each annotated quote: (``group``, case, requirement, source_id, quote) rows as spans; overlapping places too."""
    texts = contexts.select(group, F.col("id").cast("string").alias("source_id"), "text")
    places = quote_places(annotations, texts, [group, "source_id"])
    found = annotations.select(group, "case", "requirement", "source_id", "quote").join(places, [group, "source_id", "quote"])
    return found.select(group, "case", "requirement", "source_id", F.col("place").alias("start"), (F.col("place") + F.char_length("quote")).cast("int").alias("end"), F.col("quote").alias("text"))


def annotation_violations(annotations: DataFrame, pairs: DataFrame, contexts: DataFrame, group: str) -> DataFrame:
    """Cases of unknown pairs, claims or labels that changed, and quotes that their source has not."""
    told = annotations.join(pairs.select(F.col("pair_id").alias("case"), F.col("claim").alias("pair_claim"), F.col("gold_label").alias("pair_label")), "case", "left")
    texts = contexts.select(group, F.col("id").cast("string").alias("source_id"), F.col("text").alias("source_text"))
    told = told.join(texts, [group, "source_id"], "left").withColumn("key", F.concat_ws("/", F.col("case").cast("string"), "requirement"))
    blank = F.coalesce(F.col("quote"), F.lit("")) == ""
    return checks.violations(told, "key", {
        "unknown_pair": F.col("pair_claim").isNull(), "claim_changed": F.coalesce(F.col("claim") != F.col("pair_claim"), F.lit(False)), "label_changed": F.coalesce(F.col("gold_label") != F.col("pair_label"), F.lit(False)),
        "quote_missing": blank | ~F.coalesce(F.contains("source_text", F.col("quote")), F.lit(False)),
    })


def variant_retention(spans: DataFrame, chunks: DataFrame, group: str, variants: DataFrame) -> DataFrame:
    """For each variant and case what the chosen chunks (``group``, variant, source_id, start, end) keep of the annotated spans.

    ``variants`` has each (``group``, variant), so that a variant without a chunk
    of the source counts as keeping nothing.
    """
    asked = spans.join(variants, group)
    kept = retained(asked, chunks.select("variant", group, "source_id", "start", "end").join(spans.select("case", "requirement", group, "source_id").distinct(), [group, "source_id"]), ["variant", "case", "requirement", group, "source_id"])
    return case_retention(kept, ["variant", "case"], "requirement")


def truncation(pairs: DataFrame, limits: tuple[int, ...] = (512, 2048)) -> DataFrame:
    """``doc_tokens``, ``claim_tokens``, ``tokens``, and for each limit whether it cuts and what it leaves of both.

    The longer of the two loses tokens first, as long as it is the longer.
    """
    rows = pairs.withColumns({"doc_tokens": tokens_of(F.col("document")), "claim_tokens": tokens_of(F.col("claim"))}).withColumn("tokens", F.col("doc_tokens") + F.col("claim_tokens") + SPECIALS)
    for limit in limits:
        room = limit - SPECIALS
        mine = lambda a, b: F.least(F.col(a), F.greatest(F.lit(room) - F.col(b), F.lit(room // 2)))
        claim = mine("claim_tokens", "doc_tokens")
        rows = rows.withColumns({f"truncated_{limit}": F.col("tokens") > limit, f"claim_kept_{limit}": claim, f"document_kept_{limit}": F.least(F.col("doc_tokens"), room - claim)})
    return rows


def exported_cases(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """For each case and variant: the verdict, and whether the quoted anchor is in the variant's document.

    ``cases`` has pair_id, category and anchor; ``verdicts`` has pair_id, variant, document, pred and review_flag.
    """
    rows = verdicts.join(cases, "pair_id")
    at = F.nullif(F.position(F.col("anchor"), F.col("document")), F.lit(0))
    return rows.select("pair_id", "category", "variant", "pred", "review_flag", at.isNotNull().alias("anchor_present"), (at - 1).alias("anchor_at"))
