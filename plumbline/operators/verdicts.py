"""Verdicts on statements: rules, thresholds on scores, fusion and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import has_negative, is_abstention, terms

LABELS = ("supported", "conflict", "unsupported")
REVIEW = "case_review"
LEAST_COVERAGE = 0.2


def rule_verdicts(claims: DataFrame, contexts: DataFrame, group: str) -> DataFrame:
    """``label`` and the best context's ``pos`` of each claim (``claim_id``, ``group``, ``claim``).

    The best context covers most of the claim's terms; ties go to the first.
    Claims meet contexts on the group alone, by which both are dealt once; terms
    stay in their rows, and what a claim shares is counted where the two meet.
    """
    bag = lambda c: F.coalesce(F.array_distinct(terms(F.col(c))), F.array().cast("array<string>"))
    asked = claims.withColumn("__asked", bag("claim")).withColumn("n_terms", F.size("__asked"))
    offered = contexts.select(group, "pos", bag("text").alias("__offered"), has_negative(F.col("text")).alias("negative"))
    shared = F.coalesce(F.size(F.array_intersect("__offered", "__asked")), F.lit(0)).cast("long")
    scored = asked.join(offered, group, "left").withColumn("overlap", F.when(F.col("pos").isNull(), F.lit(0)).otherwise(shared)).drop("__asked", "__offered")
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy(group, "claim_id").orderBy(F.desc("overlap"), "pos"))).where("r = 1")
    coverage = F.col("overlap") / F.greatest(F.col("n_terms"), F.lit(1))
    label = (
        F.when(F.col("pos").isNull(), "unsupported").when(is_abstention(F.col("claim")), "supported").when(F.col("overlap") == 0, "unsupported")
        .when(coverage < LEAST_COVERAGE, "unsupported").when(has_negative(F.col("claim")) != F.col("negative"), "conflict").otherwise("supported")
    )
    return best.withColumn("label", label).drop("r")


def nli_label(entailment: Column, contradiction: Column, e_least: float = 0.5, c_least: float = 0.5) -> Column:
    return F.when((entailment >= e_least) & (entailment >= contradiction), "supported").when((contradiction >= c_least) & (contradiction > entailment), "conflict").otherwise("unsupported")


def nli_top(entailment: Column, contradiction: Column, neutral: Column) -> Column:
    """The largest score's name; ties in the order entailment, contradiction, neutral."""
    return F.when((entailment >= contradiction) & (entailment >= neutral), "entailment").when(contradiction >= neutral, "contradiction").otherwise("neutral")


def support_confidence(label: Column, probability: Column) -> Column:
    return F.when(label == "supported", probability).otherwise(F.round(1 - probability, 6))


def fused(support: Column, top: Column) -> tuple[Column, Column]:
    """Final label and the rule that gave it; disagreement goes to review."""
    both = (support == "supported") & (top == "entailment")
    against = (support == "unsupported") & (top == "contradiction")
    neither = (support == "unsupported") & (top == "neutral")
    label = F.when(both, "supported").when(against, "conflict").when(neither, "unsupported").otherwise(REVIEW)
    rule = F.when(both, "both_support").when(against, "unsupported_plus_contradiction").when(neither, "both_non_support_neutral").otherwise("model_disagreement")
    return label, rule


def review(reasons: Column, confidence: Column, judge: str, threshold: float = 0.7) -> tuple[Column, Column]:
    """Whether the model's confidence is low, and all reasons without repeats."""
    low = confidence < threshold
    return low, F.array_distinct(F.concat(reasons, F.when(low, F.array(F.lit(f"low_{judge}_confidence"))).otherwise(F.array().cast("array<string>"))))
