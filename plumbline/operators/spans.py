"""Character spans: overlaps, unions and labels of statements.  Spans are half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
CONFLICT_TYPES = ("Evident Conflict", "Subtle Conflict")
UNSUPPORTED_TYPES = ("Evident Baseless Info", "Subtle Baseless Info")
LOW_CLAIM_RATIO, LOW_SPAN_RATIO, BOUNDARY_CHARS = 0.20, 0.50, 3


#: Characters in a bin of the interval join.
BIN = 512


def interval_pairs(a: DataFrame, b: DataFrame, key: str, a_ends: tuple[str, str], b_ends: tuple[str, str], width: int = BIN) -> DataFrame:
    """Rows of ``a`` and ``b`` of the same ``key`` whose intervals share a place, each pair once.

    An interval is filed under every bin of ``width`` places that it touches, and
    rows meet only within a bin, so a key with very many intervals is joined
    piece by piece and by many tasks.  A pair counts in the first bin that both
    touch.  The columns of the two but for the key must differ; rows with a null
    key or end meet nothing.
    """
    def filed(df, start, end, first, name):
        low = F.floor(F.col(start) / width).cast("int")
        high = F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width).cast("int")
        return df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn(first, low).withColumn(name, F.explode(F.sequence(low, high)))

    left = filed(a, *a_ends, "__low_a", "__bin")
    right = filed(b.withColumnRenamed(key, "__k"), *b_ends, "__low_b", "__bin_b")
    near = (F.col(a_ends[0]) < F.col(b_ends[1])) & (F.col(b_ends[0]) < F.col(a_ends[1]))
    both = left.join(right, (left[key] == right["__k"]) & (F.col("__bin") == F.col("__bin_b")) & near & (F.col("__bin") == F.greatest("__low_a", "__low_b")))
    return both.drop("__k", "__bin", "__bin_b", "__low_a", "__low_b")


def overlaps(claims: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Claim and span of the same ``key`` that share a character, with how they overlap."""
    both = interval_pairs(claims, spans, key, ("claim_start", "claim_end"), ("span_start", "span_end"))
    chars = F.least("claim_end", "span_end") - F.greatest("claim_start", "span_start")
    both = both.withColumn("overlap_chars", chars)
    return both.withColumns({
        "claim_ratio": F.round(F.col("overlap_chars") / (F.col("claim_end") - F.col("claim_start")), 6),
        "span_ratio": F.round(F.col("overlap_chars") / (F.col("span_end") - F.col("span_start")), 6),
        "touches": (F.greatest("claim_start", "span_start") == F.col("claim_start")) | (F.least("claim_end", "span_end") == F.col("claim_end")),
    })


def projected(claims: DataFrame, overlapping: DataFrame, claim_key: list[str]) -> DataFrame:
    """The label that the overlapping spans give each claim, and why it should be looked at again; a type that is not known raises."""
    known = F.coalesce(F.col("label_type").isin(*CONFLICT_TYPES, *UNSUPPORTED_TYPES), F.lit(False))
    kind = F.when(known, F.col("label_type")).otherwise(F.raise_error(F.concat(F.lit("unknown span type: "), F.coalesce("label_type", F.lit("null")))).cast("string"))
    told = overlapping.groupBy(*claim_key).agg(
        F.count("*").alias("n_spans"), F.max(kind.isin(*CONFLICT_TYPES)).alias("conflict"), F.max(kind.isin(*UNSUPPORTED_TYPES)).alias("baseless"),
        F.max(kind.startswith("Subtle ")).alias("subtle"), F.max(F.col("claim_ratio") < LOW_CLAIM_RATIO).alias("low"),
        F.max(F.col("span_ratio") < LOW_SPAN_RATIO).alias("cut"), F.max(F.col("touches") & (F.col("overlap_chars") <= BOUNDARY_CHARS)).alias("edge"),
    )
    rows = claims.join(told, claim_key, "left")
    label = F.when(F.col("conflict"), "conflict").when(F.col("baseless"), "unsupported").otherwise("supported")
    reasons = F.array_compact(F.array(
        F.when(F.col("subtle"), "subtle_gold_span"), F.when(F.col("conflict") & F.col("baseless"), "mixed_gold_types"), F.when(F.col("n_spans") > 1, "multiple_gold_spans"),
        F.when(F.col("low"), "low_claim_overlap"), F.when(F.col("cut"), "span_split_across_claims"), F.when(F.col("edge"), "boundary_only_overlap"),
    ))
    return rows.select(*claim_key, label.alias("gold_label"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), reasons.alias("review_reasons"))


def union_pieces(spans: DataFrame, key: str) -> DataFrame:
    """Touching or overlapping spans of a ``key`` made one: ``key``, ``span_start``, ``span_end``."""
    w = Window.partitionBy(key).orderBy("span_start", "span_end")
    reach = F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (reach.isNull() | (F.col("span_start") > reach)).cast("int"))
    piece = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("piece", piece).groupBy(key, "piece").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("piece")


def covered_chars(pieces: DataFrame, key: str) -> DataFrame:
    return pieces.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("chars"))


def shared_chars(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Characters in both of two sets of disjoint pieces."""
    left = a.select(key, F.col("span_start").alias("s"), F.col("span_end").alias("e"))
    both = interval_pairs(left, b.select(key, "span_start", "span_end"), key, ("s", "e"), ("span_start", "span_end"))
    return both.groupBy(key).agg(F.sum(F.least("e", "span_end") - F.greatest("s", "span_start")).alias("shared"))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, or 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
