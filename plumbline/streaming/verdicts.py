"""Rules on streams of statement-and-evidence pairs: stateless, so any trigger will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import has_negative, is_abstention, terms
from plumbline.operators.verdicts import LEAST_COVERAGE


def judge_pairs(pairs: DataFrame) -> DataFrame:
    """``label`` for rows with a claim and one document; works on a stream as on a table."""
    mine = F.array_distinct(terms(F.col("claim")))
    shared = F.size(F.array_intersect(mine, terms(F.col("document"))))
    coverage = shared / F.greatest(F.size(mine), F.lit(1))
    label = F.when(F.coalesce(F.col("document"), F.lit("")) == "", "unsupported").when(is_abstention(F.col("claim")), "supported").when((shared == 0) | (coverage < LEAST_COVERAGE), "unsupported").when(has_negative(F.col("claim")) != has_negative(F.col("document")), "conflict").otherwise("supported")
    return pairs.withColumn("label", label)
