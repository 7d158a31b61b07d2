"""Reports on judged pairs and responses, in long form: a row for each group, part and metric.

Verdicts of several methods or variants are rows with a column that names them,
so one job evaluates all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import checks, metrics
from plumbline.operators.spans import covered_chars, ratio, shared_chars, union_pieces
from plumbline.operators.verdicts import LABELS, REVIEW

#: The fields in which a result must be what its input pair was.
INPUT_FIELDS = ("qid", "claim_id", "document", "claim", "gold_label", "gold_projection_version", "split_rule_version")
FROZEN_FIELDS = ("qid", "source_id", "claim_id", "claim", "claim_start", "claim_end", "gold_label", "gold_projection_version", "split_rule_version", "schema_version")
#: The labels each method may give.
ALLOWED = {"support": ("supported", "unsupported"), "nli": LABELS, "fused": (*LABELS, REVIEW)}


def metric_rows(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Wide numbers as rows (``by``, ``metric``, ``value``)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*by, F.inline(pairs))


def subsets(rows: DataFrame) -> DataFrame:
    """Each row under every subset it belongs to: all, those decided, those not flagged for review."""
    tags = F.array_compact(F.array(F.lit("full_set"), F.when(F.col("pred") != REVIEW, "decided_only"), F.when(~F.col("review_flag"), "unflagged_only")))
    return rows.withColumn("subset", F.explode(tags))


def classification(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by``, ``label`` (null for all), ``metric`` and ``value`` for rows of gold and pred; unknown labels raise.

    One aggregation counts (gold, pred); all else comes from these few rows.
    """
    by = list(by)
    cells = metrics.confusion(rows, by)
    each = metrics.per_class(cells, by)
    for name, trials in (("precision", F.col("tp") + F.col("fp")), ("recall", F.col("tp") + F.col("fn"))):
        low, high = metrics.wilson(F.col("tp"), trials)
        each = each.withColumns({f"{name}_low": low, f"{name}_high": high})
    total = metrics.overall(cells, by)
    low, high = metrics.wilson(F.col("correct"), F.col("rows"))
    total = total.withColumns({"accuracy_low": low, "accuracy_high": high})
    macro = each.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    classes = metric_rows(each, [*by, "label"], ["tp", "fp", "fn", "support", "precision", "recall", "f1", "precision_low", "precision_high", "recall_low", "recall_high"])
    parts = [metric_rows(total, by, ["rows", "abstained", "accuracy", "accuracy_low", "accuracy_high"]), metric_rows(macro, by, ["macro_f1"])]
    whole = checks.union([p.withColumn("label", F.lit(None).cast("string")) for p in parts])
    return classes.unionByName(whole).select(*by, "label", "metric", "value")


def binary_counts() -> dict[str, Column]:
    """Counts of supported against not supported; an abstention on a bad statement is a miss."""
    bad, said, open_ = F.col("gold") != "supported", F.col("pred").isin("conflict", "unsupported"), F.col("pred") == REVIEW
    n = F.count_if
    return {
        "tp": n(bad & said), "fp": n(~bad & said), "fn": n(bad & ~said), "tn": n(~bad & (F.col("pred") == "supported")),
        "abstentions": n(open_), "abstentions_positive_gold": n(bad & open_), "abstentions_negative_gold": n(~bad & open_),
        "conflict_to_unsupported": n((F.col("gold") == "conflict") & (F.col("pred") == "unsupported")), "unsupported_to_conflict": n((F.col("gold") == "unsupported") & (F.col("pred") == "conflict")),
    }


def binary_report(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """``binary_counts`` of each group with the rates that follow from them."""
    sizes = {f"gold_{x}": F.count_if(F.col("gold") == x) for x in ("conflict", "unsupported")}
    counts = rows.groupBy(*by).agg(F.count("*").alias("rows"), *(c.alias(name) for name, c in (binary_counts() | sizes).items()))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, F.col("rows")),
        "conflict_to_unsupported_rate": ratio(F.col("conflict_to_unsupported"), F.col("gold_conflict")), "unsupported_to_conflict_rate": ratio(F.col("unsupported_to_conflict"), F.col("gold_unsupported")),
    }).drop("gold_conflict", "gold_unsupported")


def value_counts(rows: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """How often each value of ``column`` comes; of an array, each different value once for a row."""
    if rows.schema[column].dataType.typeName() == "array":
        rows = rows.select(*by, F.explode(F.array_distinct(column)).alias(column))
    return rows.groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def single_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rules broken where a column, say of provenance, has not exactly one value that is neither null nor empty."""
    kinds = rows.agg(*(F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in columns))
    each = kinds.select(F.inline(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("values")) for c in columns))))
    return each.where((F.size("values") != 1) | F.array_contains("values", "")).select(F.lit("not_single").alias("rule"), "key")


def pair_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``part``, ``name`` and ``value``: all that is told of judged pairs (gold, pred, review_flag, review_reasons)."""
    by = list(by)
    label = F.coalesce("label", F.lit("all"))
    classes = classification(subsets(rows), [*by, "subset"]).select(*by, F.col("subset").alias("part"), F.concat_ws(".", label, "metric").alias("name"), "value")
    binary = binary_report(rows, by)
    binary = metric_rows(binary, by, [c for c in binary.columns if c not in by]).select(*by, F.lit("binary").alias("part"), F.col("metric").alias("name"), "value")
    n, decided, unflagged = F.count("*"), F.count_if(F.col("pred") != REVIEW), F.count_if(~F.col("review_flag"))
    shares = rows.groupBy(*by).agg(ratio(decided, n).alias("decision_coverage"), ratio(unflagged, n).alias("unflagged_coverage"), (n - decided).alias("case_review_count"), (n - unflagged).alias("review_count"), ratio(n - unflagged, n).alias("review_rate"))
    shares = metric_rows(shares, by, [c for c in shares.columns if c not in by]).select(*by, F.lit("coverage").alias("part"), F.col("metric").alias("name"), "value")
    counted = [value_counts(rows, c, by).select(*by, F.lit(part).alias("part"), F.col("value").alias("name"), F.col("n").cast("double").alias("value")) for c, part in (("gold", "gold_label"), ("pred", "pred_label"), ("review_reasons", "review_reason"))]
    return checks.union([classes, binary, shares, *counted])


def result_violations(results: DataFrame, inputs: DataFrame, field: str, method: str, provenance: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """What keeps results from being evaluated against their input: keys, frozen fields, labels, flags, provenance."""
    fields = [f for f in INPUT_FIELDS if f in results.columns and f in inputs.columns]
    rules = {
        "label": ~F.coalesce(F.col(field).isin(*ALLOWED[method]), F.lit(False)), "gold": ~F.coalesce(F.col("gold_label").isin(*LABELS), F.lit(False)),
        "review_flag": F.col("review_flag").isNull(), "review_without_flag": (F.col(field) == REVIEW) & ~F.coalesce("review_flag", F.lit(False)),
    }
    return checks.union([
        checks.compared(results, inputs, "pair_id", fields), checks.violations(results, "pair_id", rules), single_values(results, [c for c in provenance if c in results.columns]),
    ])


def audited_rows(results: DataFrame, frozen: DataFrame) -> DataFrame:
    """The results of an audited set's pairs, with the audited label as gold; the whole run is evaluated before."""
    return results.drop("gold").join(frozen.select("pair_id", F.col("gold_label").alias("gold")), "pair_id")


def response_report(rows: DataFrame) -> DataFrame:
    """``part``, ``name``, ``value`` for responses: found against annotated, by response, by character and by model.

    ``rows`` has qid, gold_hallucinated, predicted_hallucinated, predicted_spans,
    gold_spans, pred_labels and generator_model.
    """
    gold, said = F.col("gold_hallucinated"), F.col("predicted_hallucinated")
    n = F.count_if
    counts = rows.agg(F.count("*").alias("samples"), n(gold & said).alias("tp"), n(~gold & said).alias("fp"), n(gold & ~said).alias("fn"), n(~gold & ~said).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, F.col("samples"))}
    counts = counts.withColumns({k: F.round(v, 4) for k, v in rates.items()})
    parts = [metric_rows(counts, [], counts.columns).select(F.lit("response").alias("part"), F.col("metric").alias("name"), "value")]
    pieces = {c: union_pieces(rows.select("qid", F.inline(c)).select("qid", F.col("start").alias("span_start"), F.col("end").alias("span_end")), "qid") for c in ("predicted_spans", "gold_spans")}
    sums = [covered_chars(p, "qid").agg(F.sum("chars").alias("v")).select(F.lit(c).alias("what"), "v") for c, p in pieces.items()]
    shared = shared_chars(pieces["predicted_spans"], pieces["gold_spans"], "qid").agg(F.sum("shared").alias("v")).select(F.lit("shared").alias("what"), "v")
    of = lambda x: F.coalesce(F.sum(F.when(F.col("what") == x, F.col("v"))), F.lit(0))
    chars = checks.union([*sums, shared]).agg(of("predicted_spans").alias("p"), of("gold_spans").alias("g"), of("shared").alias("s"))
    chars = chars.select(F.round(ratio(F.col("s"), F.col("p")), 4).alias("precision"), F.round(ratio(F.col("s"), F.col("g")), 4).alias("recall"), F.round(ratio(2 * F.col("s"), F.col("p") + F.col("g")), 4).alias("f1"))
    parts.append(metric_rows(chars, [], chars.columns).select(F.lit("span").alias("part"), F.col("metric").alias("name"), "value"))
    kinds = rows.select(F.inline("gold_spans")).groupBy("label_type").count().select(F.lit("gold_span_type").alias("part"), F.col("label_type").alias("name"), F.col("count").cast("double").alias("value"))
    labels = rows.select(F.explode("pred_labels").alias("l")).groupBy("l").count().select(F.lit("pred_label").alias("part"), F.col("l").alias("name"), F.col("count").cast("double").alias("value"))
    models = rows.groupBy(F.coalesce("generator_model", F.lit("unknown")).alias("model")).agg(F.count("*").alias("samples"), n(gold).alias("gold_hallucinated"), n(said).alias("predicted_hallucinated"), n(gold == said).alias("correct"))
    models = models.withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("samples")), 4))
    by_model = metric_rows(models, ["model"], ["samples", "gold_hallucinated", "predicted_hallucinated", "correct", "accuracy"])
    return checks.union([*parts, kinds, labels, by_model.select(F.lit("model").alias("part"), F.concat_ws(".", "model", "metric").alias("name"), "value")])


def comparisons(verdicts: DataFrame, pairs_of: list[tuple[str, str]], variant: str = "variant") -> DataFrame:
    """What each variant changed against another: a row for each pair of ``pairs_of`` and pair_id.

    The list is small and fixed; every verdict row goes to the comparisons it is
    part of and meets its partner on (comparison, pair_id).
    """
    sides = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(a).alias("from_variant"), F.lit(b).alias("to_variant"), F.lit(side).alias("side"), F.lit((a, b)[side]).alias("mine")) for i, (a, b) in enumerate(pairs_of) for side in (0, 1)))
    rows = verdicts.select("pair_id", F.col(variant).alias("v"), "gold", "pred", F.explode(F.filter(sides, lambda s: s["mine"] == F.col(variant))).alias("s")).select("pair_id", "gold", "pred", "s.*")
    both = rows.groupBy("c", "from_variant", "to_variant", "pair_id").agg(F.min("gold").alias("gold"), F.max("gold").alias("other_gold"), F.count("*").alias("n"), F.max(F.when(F.col("side") == 0, F.col("pred"))).alias("from_pred"), F.max(F.when(F.col("side") == 1, F.col("pred"))).alias("to_pred"))
    paired = (F.col("n") == 2) & (F.col("gold") == F.col("other_gold")) & F.col("from_pred").isNotNull() & F.col("to_pred").isNotNull()
    change = F.when(paired, metrics.change(F.col("gold"), F.col("from_pred"), F.col("to_pred"))).otherwise("not_paired")
    return both.select("from_variant", "to_variant", "pair_id", "gold", "from_pred", "to_pred", change.alias("change"))


def change_report(changes: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each change by gold label, and the share of flips."""
    return changes.groupBy(*by, "gold", "change").agg(F.count("*").alias("n"))


def order_comparisons(methods: tuple[str, ...]) -> list[tuple[str, str]]:
    """Which variants of an order control are set against which: rank against source order, the stored run against its repetition, and the whole sources."""
    return [*((f"{m}_rank", f"{m}_source") for m in methods), *((f"old_{m}", f"{m}_rank") for m in methods), ("old_full_source", "full_chunked_source")]


def experiment_report(verdicts: DataFrame, pairs_of: list[tuple[str, str]]) -> DataFrame:
    """``part``, ``name``, ``item`` and ``value``: every variant's metrics, and what changed in every comparison, all labels together and one by one.

    One job whatever the number of comparisons.  A stored run takes part as
    variants of its own, so drift is a comparison like others.
    """
    told = classification(verdicts, ["variant"])
    scores = told.select(F.lit("metric").alias("part"), F.col("variant").alias("name"), F.concat_ws(".", "label", "metric").alias("item"), "value")
    changes = comparisons(verdicts, pairs_of).withColumn("name", F.concat("from_variant", F.lit("->"), "to_variant"))
    each = changes.select("name", F.explode(F.array(F.struct(F.lit("change").alias("part"), F.col("change").alias("item")), F.struct(F.lit("change_by_gold").alias("part"), F.concat_ws(".", "gold", "change").alias("item")))).alias("x"))
    counts = each.groupBy(F.col("x.part").alias("part"), "name", F.col("x.item").alias("item")).agg(F.count("*").cast("double").alias("value"))
    return scores.unionByName(counts)


def flip_report(changes: DataFrame, by: list[str]) -> DataFrame:
    """Flips of all and of those whose order changed (null of none), and flips of the same input; needs ``order_changed``."""
    flip = F.col("change") != "unchanged"
    n, moved = F.count("*"), F.count_if("order_changed")
    return changes.groupBy(*by).agg(n.alias("pairs"), moved.alias("order_changed_pairs"), ratio(F.count_if(flip), n).alias("flip_rate_all"), F.try_divide(F.count_if(flip & F.col("order_changed")), moved).alias("flip_rate_changed_order"), F.count_if(flip & ~F.col("order_changed")).alias("identical_input_flips"))


def variant_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each variant: accuracy, macro-F1, tokens, truncation, latency, review, and how many candidates it had.

    ``rows`` has gold, pred, review_flag, input_tokens, was_truncated, latency_ms,
    selection_latency_ms, actual_k and candidate_shortfall.
    """
    told = classification(rows, by)
    scores = told.where("label is null and metric in ('accuracy', 'macro_f1') or label = 'conflict' and metric = 'recall'")
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    scores = scores.groupBy(*by).agg(value("accuracy").alias("accuracy"), value("macro_f1").alias("macro_f1"), value("recall").alias("conflict_recall"))
    n = F.count("*")
    sums = rows.groupBy(*by).agg(
        n.alias("samples"), ratio(F.count_if("review_flag"), n).alias("review_rate"), F.avg("input_tokens").alias("mean_input_tokens"), F.max("input_tokens").alias("max_input_tokens"),
        F.count_if("was_truncated").alias("truncated_count"), F.avg("latency_ms").alias("mean_judge_latency_ms"), F.avg("selection_latency_ms").alias("mean_selection_latency_ms"),
        F.avg(F.col("latency_ms") + F.col("selection_latency_ms")).alias("mean_total_latency_ms"), F.count_if("candidate_shortfall").alias("candidate_shortfall_count"),
    )
    return scores.join(sums, list(by))


def retention_outcomes(cases: DataFrame, verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Whether annotated evidence was there, against whether the verdict was right."""
    both = cases.join(verdicts.select(*by, "pair_id", "gold", "pred"), [*by, "pair_id"])
    outcome = F.concat(F.when(F.col("complete"), "anchors_present").otherwise("anchor_missing"), F.when(F.col("gold") == F.col("pred"), "_correct").otherwise("_wrong"))
    return both.groupBy(*by, outcome.alias("outcome")).agg(F.count("*").alias("n"))


def length_buckets(rows: DataFrame, tokens: str, limits: tuple[int, ...] = (512, 2048)) -> DataFrame:
    """Rows and errors for all, for those up to each limit and those beyond it; buckets overlap."""
    short, long = limits
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col(tokens) <= short, f"le{short}"), F.when(F.col(tokens) > short, f"gt{short}"), F.when(F.col(tokens) > long, f"gt{long}")))
    return rows.withColumn("bucket", F.explode(tags)).groupBy("bucket").agg(F.count("*").alias("rows"), F.count_if(F.col("gold") != F.col("pred")).alias("errors"))


def upper_median(rows: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Smallest, middle (the upper of two) and largest value, exactly: by counts of the different values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("times"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("times").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    told = counts.withColumns({"upto": upto, "total": F.sum("times").over(w)})
    return told.groupBy(*by).agg(F.min(column).alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(column))).alias("median"), F.max(column).alias("most"))


def length_rules(column: str, ceiling: int = 2048) -> dict[str, Column]:
    return {"length": ~F.coalesce((F.col(column) > 0) & (F.col(column) <= ceiling), F.lit(False))}


def frozen_violations(pairs: DataFrame, frozen: DataFrame, choices: DataFrame, budget: int = 512) -> DataFrame:
    """What a variant's pairs and choices must not have changed, and its budget; ``choices`` has the selected ids and counts."""
    fields = [f for f in FROZEN_FIELDS if f in pairs.columns and f in frozen.columns]
    told = pairs.join(choices.select("pair_id", "selected_ids", "selected_count", "input_tokens", "was_truncated"), "pair_id")
    rules = {
        "selected_ids": ~F.col("document_ids").eqNullSafe(F.col("selected_ids")) | (F.size("selected_ids") < 1), "selected_count": F.col("selected_count") != F.size("selected_ids"),
        "budget": (F.col("input_tokens") > budget) | F.col("was_truncated"),
    }
    return checks.union([checks.compared(pairs, frozen, "pair_id", fields, repeated=False), checks.compared(pairs, choices, "pair_id", [], repeated=False), checks.violations(told, "pair_id", rules)])
