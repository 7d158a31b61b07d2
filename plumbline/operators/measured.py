"""Measured runs: pairs judged batch by batch by a judge that is timed, and the run's account from the job that writes the results."""

from __future__ import annotations

import time
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.operators.checks import duplicates, enforce
from plumbline.operators.judges import ScorerFactory, numbered_batches
from plumbline.sources.runs import refuse_existing

MEASUREMENT = "batch_wall_clock_amortized"


def _judged(factory: ScorerFactory, names: tuple[str, ...]):
    """From rows (key, batch, premise, hypothesis) sorted by batch and key: the scores, and what the batch took in milliseconds."""
    def run(batches):
        scorer, held = factory(), []

        def scored():
            began = time.perf_counter()
            scores = scorer([h[2] for h in held], [h[3] for h in held])
            took = (time.perf_counter() - began) * 1000
            if len(scores) != len(held):
                raise RuntimeError(f"the judge gave {len(scores)} results for {len(held)} pairs")
            columns = [pa.array([h[0] for h in held]), *(pa.array([round(float(s[i]), 6) for s in scores], pa.float64()) for i in range(len(names))), pa.array([took] * len(held))]
            return pa.RecordBatch.from_arrays(columns, names=["__k", *names, "__took"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][1] != row[1]:
                    yield scored()
                    held.clear()
                held.append(row)
        if held:
            yield scored()

    return run


def judged_pairs(pairs: DataFrame, factory: ScorerFactory, names: tuple[str, ...], key: str = "pair_id", premise: str = "document", hypothesis: str = "claim", batch_size: int = 64, order: str | None = None) -> DataFrame:
    """``pairs`` with the scores ``names``, their lengths in characters, the batch they were in and its time shared out.

    Batches are of ``batch_size`` pairs in ``order`` (the key without one),
    whatever tasks judge them; a batch is judged at once.  Pairs that share a
    key, or have none, raise before anything is judged.  ``latency_ms`` is the
    batch's wall clock over its size.
    """
    enforce(duplicates(pairs, key))
    if not pairs.where(F.col(key).isNull()).isEmpty():
        raise ValueError("a pair has no key")
    rows = numbered_batches(pairs, order or key, batch_size)
    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(F.col(key).alias("__k"), "batch_id", F.coalesce(premise, F.lit("")).alias("p"), F.coalesce(hypothesis, F.lit("")).alias("h"))
    asked = asked.repartition("batch_id").sortWithinPartitions("batch_id", "__k")
    scores = asked.mapInArrow(_judged(factory, names), f"__k {kind}, " + ", ".join(f"{n} double" for n in names) + ", __took double")
    lengths = {"document_len": F.char_length(F.coalesce(premise, F.lit(""))), "claim_len": F.char_length(F.coalesce(hypothesis, F.lit("")))}
    told = rows.withColumns(lengths).join(scores, F.col(key) == F.col("__k"))
    timing = {"batch_latency_ms": F.round("__took", 3), "latency_ms": F.round(F.col("__took") / F.col("batch_size"), 3), "latency_measurement": F.lit(MEASUREMENT)}
    return told.withColumns(timing).drop("__k", "__took")


def write_results(results: DataFrame, path: str, labels: tuple[str, ...], label: str = "pred_label", score: str = "score", flag: str = "review_flag", batch_size: int = 64) -> dict:
    """Write ``results`` and give the run's account: pairs, batches, labels, those to review, the scores' range, lengths and times.

    All of it is observed while the rows are written: nothing is read again.  A
    label that is none of ``labels`` counts as ``other``.  An existing path is an
    error.
    """
    spark = results.sparkSession
    refuse_existing(spark, path)
    seen = Observation()
    known = F.coalesce(F.col(label).isin(*labels), F.lit(False))
    watched = results.observe(
        seen, F.count(F.lit(1)).alias("pairs"), *(F.count_if(F.col(label) == x).alias(f"label_{x}") for x in labels), F.count_if(~known).alias("label_other"), F.count_if(F.coalesce(flag, F.lit(False))).alias("review_pairs"),
        F.round(F.min(score), 6).alias("score_min"), F.round(F.max(score), 6).alias("score_max"), F.sum("document_len").alias("document_chars"), F.sum("claim_len").alias("claim_chars"), F.sum("latency_ms").alias("judged_ms"),
        F.sum(F.lit(1.0) / F.col("batch_size")).alias("batches"), F.max("batch_latency_ms").alias("slowest_batch_ms"),
    )
    started, began = datetime.now(timezone.utc), time.perf_counter()
    watched.write.mode("errorifexists").parquet(path)
    took = time.perf_counter() - began
    got = dict(seen.get)
    counts = {x: got.pop(f"label_{x}") for x in (*labels, "other")}
    return {
        **got, "batches": round(got["batches"] or 0), "pred_label_counts": {x: n for x, n in sorted(counts.items()) if n}, "configured_batch_size": batch_size,
        "started_at_utc": started.isoformat(), "finished_at_utc": datetime.now(timezone.utc).isoformat(), "elapsed_seconds": round(took, 3),
        "latency_definition": "Per-pair latency is batch wall-clock time divided by actual batch size.",
    }


def batch_timings(results: DataFrame) -> DataFrame:
    """A row for each batch of written results: its pairs and times."""
    return results.groupBy("batch_id").agg(F.count("*").alias("pair_count"), F.first("batch_latency_ms").alias("batch_latency_ms"), F.first("latency_ms").alias("amortized_pair_latency_ms"))
