"""Responses that are verified, and queries that are answered from their passages first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import terms
from plumbline.operators import ranking
from plumbline.operators.claims import split_claims
from plumbline.operators.places import null_safe
from plumbline.operators.spans import ratio

#: Fixed values of the ranking.
NUMERATOR, K1 = 2.0, 1.2


def answered(samples: DataFrame, contexts: DataFrame, refusal: str, *, group: str = "qid", top_k: int = 2) -> DataFrame:
    """``qid``, ``mode``, ``answer`` and ``evidence`` (id, text) of each sample.

    ``samples`` has qid, ``group``, query and answer; ``contexts`` has ``group``,
    pos, id and text.  A sample with an answer is verified against all its
    contexts in order.  One without is generated: passages are ranked, ``top_k``
    of those that share a term with the query (or the first) are the evidence,
    and the answer is its best sentence, or ``refusal``.  A null query counts as
    empty; a sample without contexts has no evidence.
    """
    keep = list(dict.fromkeys(["qid", group]))
    asked = samples.where("answer is null").select(*keep, F.coalesce("query", F.lit("")).alias("query"))
    pool = contexts.select(group, "pos", F.struct("pos", F.col("id").cast("string").alias("id"), "text").alias("c"))
    scored = ranking.bm25(asked, contexts.select(group, "pos", "text"), terms, group=group, numerator=NUMERATOR, k1=K1, distinct_terms=False, digits=4)
    kept = ranking.evidence_filter(ranking.ranked(scored), F.col("overlap"), top_k).select("qid", "pos", "kept_rank")
    used = kept.join(asked.select(*keep), "qid").join(pool, [group, "pos"])
    sentences = split_claims(used.select(F.struct("qid", "kept_rank").alias("k"), F.col("c.text").alias("text")), "k", "text").select("k.*", "claim_no", "claim")
    said = ranking.extractive_answers(asked.select("qid", "query"), sentences, refusal).select("qid", F.lit("generation").alias("mode"), "answer")
    given = samples.where("answer is not null").select("qid", F.lit("verification").alias("mode"), "answer")
    every = samples.where("answer is not null").select(*keep).join(pool, group).select("qid", F.col("pos").alias("place"), "c")
    rows = every.unionByName(used.select("qid", F.col("kept_rank").cast(every.schema["place"].dataType).alias("place"), "c"))
    evidence = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: F.struct(x["c"]["id"].alias("id"), x["c"]["text"].alias("text"))).alias("evidence"))
    none = F.array().cast("array<struct<id:string,text:string>>")
    return null_safe(given.unionByName(said), evidence, ["qid"], "left").withColumn("evidence", F.coalesce("evidence", none))


def evidence_recall(retrieved: Column, gold: Column) -> Column:
    """The share of the different gold ids that are among the retrieved ones; null where there is no gold."""
    wanted = F.array_distinct(gold)
    return F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(wanted, retrieved)) / F.size(wanted), 4))


def token_f1(rows: DataFrame, key: str, said: str, meant: str) -> DataFrame:
    """``key``, ``shared`` and ``token_f1`` of the bags of terms of two texts; 0 where either has none."""
    bag = lambda c, n: rows.select(key, F.explode(terms(F.col(c))).alias("term")).groupBy(key, "term").agg(F.count("*").alias(n))
    each = bag(said, "a").join(bag(meant, "b"), [key, "term"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in "ab"})
    both = each.groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"), F.sum(F.col("a") + F.col("b")).alias("total"))
    told = null_safe(rows.select(key), both, [key], "left")
    return told.select(key, F.coalesce("shared", F.lit(0).cast("long")).alias("shared"), ratio(2.0 * F.coalesce("shared", F.lit(0)), F.coalesce("total", F.lit(0))).alias("token_f1"))
