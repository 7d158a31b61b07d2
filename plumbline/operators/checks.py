"""Validators: each gives rows (rule, key, detail) of what is wrong; ``enforce`` raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.verdicts import LABELS
from plumbline.sources.scratch import written

#: Rows of two tables that a task compares, about: a larger table has more tasks, not larger ones.
TASK_ROWS = 1 << 20


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """All broken rules of all rows in one scan; a rule's column is true where it is broken."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items())))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    found = df.groupBy(key).count().where("count > 1")
    return found.select(F.lit("duplicate_key").alias("rule"), F.col(key).cast("string").alias("key"))


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    only = lambda x, y, name: x.select(key).join(y.select(key), key, "left_anti").select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    return only(a, b, "only_left").unionByName(only(b, a, "only_right"))


def field_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields on which rows of equal keys differ; null equals null."""
    right = b.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    return violations(a.join(right, key), key, {f"differs_{f}": ~F.col(f).eqNullSafe(F.col(f"__{f}")) for f in fields})


def compared(a: DataFrame, b: DataFrame, key: str, fields: list[str], repeated: bool = True) -> DataFrame:
    """``key_differences``, ``field_differences`` and, if ``repeated``, the ``duplicates`` of both sides, by one shuffle.

    Rows are counted first and dealt by key to so many tasks that each has about
    ``TASK_ROWS``.  Keys that come once on a side at most, nearly all, are
    compared in one grouping; rows of others, and those without a key, are joined.
    """
    flat = lambda df, left: df.select(F.col(key).alias("key"), F.lit(left).alias("left"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    tasks = -(-(a.count() + b.count()) // TASK_ROWS)
    dealt = lambda df, by: df.repartition(tasks, by) if tasks > a.sparkSession.sparkContext.defaultParallelism else df.repartition(by)
    of = lambda i, side: F.first(F.when(side, F.col(f"f{i}")), ignorenulls=True)
    left = F.col("left")
    sides = [F.count_if(left).alias("l"), F.count_if(~left).alias("r"), *(of(i, s).alias(f"{x}{i}") for i in range(len(fields)) for x, s in (("l", left), ("r", ~left)))]
    keys = dealt(flat(a, True).unionByName(flat(b, False)), "key").groupBy("key").agg(*sides)
    l, r, known = F.col("l"), F.col("r"), F.col("key").isNotNull()  # noqa: E741
    once = known & (l <= 1) & (r <= 1)
    rules = [("only_left", once & (r == 0)), ("only_right", once & (l == 0)), *((f"differs_{f}", once & (l == 1) & (r == 1) & ~F.col(f"l{i}").eqNullSafe(F.col(f"r{i}"))) for i, f in enumerate(fields)), ("again", ~once)]
    rules += [("duplicate_key", l > 1), ("duplicate_key", r > 1)] if repeated else []
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules)))
    found = written(keys.select(F.explode(broken).alias("rule"), "key"), "compared")
    again = found.where("rule = 'again'").select(F.col("key").alias("__again"))
    told = found.where("rule <> 'again'").select("rule", F.col("key").cast("string").alias("key"))
    if again.isEmpty():
        return told
    rest = [dealt(df.join(again, F.col(key).eqNullSafe(F.col("__again")), "left_semi"), key) for df in (a, b)]
    return union([told, key_differences(*rest, key), field_differences(*rest, key, fields)])


def span_rules(answer: str = "answer") -> dict[str, Column]:
    s = lambda f: F.exists("gold_spans", f)
    return {
        "span_bounds": s(lambda x: (x["start"] < 0) | (x["end"] <= x["start"])), "span_end": s(lambda x: x["end"] > F.char_length(answer)),
        "span_text": s(lambda x: x["text"].isNotNull() & (F.substr(F.col(answer), x["start"] + 1, x["end"] - x["start"]) != x["text"])),
    }


SCORES = ("entailment", "contradiction", "neutral")


def score_rules() -> dict[str, Column]:
    """What a three-way result's scores, top label, lengths and flag must be; of scores that tie the first named is the top."""
    best = F.greatest(*SCORES)
    first = F.coalesce(*(F.when(F.col(c) == best, F.lit(c)) for c in SCORES))
    return {
        "probability": F.exists(F.array(*SCORES), lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1)), "top_label": F.col("top_label") != first, "top_score": F.col("top_score") != best, "score": (F.col("score") < 0) | (F.col("score") > 1),
        "document_len": F.col("document_len") != F.char_length("document"), "claim_len": F.col("claim_len") != F.char_length("claim"), "review_flag": F.col("review_flag").isNull(),
    }


def binary_rules() -> dict[str, Column]:
    """What a two-way result must be: its prediction is its label's."""
    return {"prediction": F.col("prediction") != (F.col("pred_label") == "supported").cast("int"), "label": ~F.col("pred_label").isin("supported", "unsupported"), "score": (F.col("score") < 0) | (F.col("score") > 1)}


def result_rules() -> dict[str, Column]:
    total = F.col("entailment") + F.col("contradiction") + F.col("neutral")
    return {"label": ~F.col("pred_label").isin(*LABELS), "gold": ~F.col("gold_label").isin(*LABELS), "probability_sum": F.abs(total - 1) > 0.001, "latency": F.col("latency_ms") < 0}


def enforce(found: DataFrame) -> None:
    """Raise with some samples if anything is wrong."""
    some = found.take(5)
    if some:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']}" for r in some))


def content_hash(df: DataFrame, key: str) -> str:
    """A hash of all rows that no order or file layout changes."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    a, b = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    return f"{a}:{b}"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
