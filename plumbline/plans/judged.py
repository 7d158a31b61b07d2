"""Queries over verdicts of judges.  Lines of orders stand for judged pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audit, checks, evaluation, metrics, spans, verdicts
from plumbline.plans.registry import query
from plumbline.session import table

PAIRS_SQL = """pairs as (select l_orderkey * 10 + l_linenumber id, l_shipmode_free g, case l_returnflag when 'A' then 'supported' when 'R' then 'conflict' else 'unsupported' end gold,
 case (l_partkey * 7 + l_suppkey) % 4 when 0 then 'supported' when 1 then 'conflict' when 2 then 'unsupported' else 'case_review' end pred,
 case (l_partkey * 3 + l_linenumber) % 3 when 0 then 'supported' when 1 then 'conflict' else 'unsupported' end later from (select *, l_linestatus l_shipmode_free from lineitem) x)"""


def pairs(spark, d):
    pick = lambda c, names: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linestatus").alias("g"),
        F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "conflict").otherwise("unsupported").alias("gold"),
        pick((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 4, (*verdicts.LABELS, verdicts.REVIEW)).alias("pred"),
        pick((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 3, verdicts.LABELS).alias("later"),
    )


GRID_SQL = "grid as (select gold, pred from (select unnest(['supported', 'conflict', 'unsupported']) gold) a, (select unnest(['supported', 'conflict', 'unsupported', 'case_review']) pred) b)"
CELLS_SQL = f"with {PAIRS_SQL}, {GRID_SQL}, cells as (select grid.gold, grid.pred, count(id) n from grid left join pairs on pairs.gold = grid.gold and pairs.pred = grid.pred group by grid.gold, grid.pred)"
CLASS_SQL = CELLS_SQL + """, c as (select label, cast(sum(case when gold = label and pred = label then n else 0 end) as bigint) tp, cast(sum(case when gold <> label and pred = label then n else 0 end) as bigint) fp, cast(sum(case when gold = label and pred <> label then n else 0 end) as bigint) fn
 from cells, (select unnest(['supported', 'conflict', 'unsupported']) label) l group by label)"""


@query(CELLS_SQL + " select * from cells")
def confusion_3class(spark, d):
    return metrics.confusion(pairs(spark, d))


@query(CLASS_SQL + " select label, tp, fp, fn, tp + fn support, tp::double / (tp + fp) as \"precision\", tp::double / (tp + fn) recall, 2.0 * tp / (2 * tp + fp + fn) f1 from c")
def class_metrics(spark, d):
    return metrics.per_class(metrics.confusion(pairs(spark, d)))


@query(CLASS_SQL + """, w as (select label, tp, (tp + fn)::double n, tp / (tp + fn)::double p, 1.959963984540054 z from c)
select label, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) low, round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) high from w""")
def wilson_by_class(spark, d):
    low, high = metrics.wilson(F.col("tp"), F.col("support"))
    return class_metrics(spark, d).select("label", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query(f"with {PAIRS_SQL}, s as (select *, unnest(['all', case when pred <> 'case_review' then 'decided_only' end, case when id % 3 <> 0 then 'unflagged_only' end]) subset from pairs) select subset, count(*) as \"rows\", cast(sum((gold = pred)::int) as bigint) correct, cast(sum((pred = 'case_review')::int) as bigint) abstained, sum((gold = pred)::int)::double / count(*) accuracy from s where subset is not null group by subset")
def subset_metrics(spark, d):
    tags = F.array(F.lit("all"), F.when(F.col("pred") != verdicts.REVIEW, "decided_only"), F.when(F.col("id") % 3 != 0, "unflagged_only"))
    tagged = pairs(spark, d).withColumn("subset", F.explode(tags)).where("subset is not null")
    return metrics.overall(metrics.confusion(tagged, ["subset"]), ["subset"])


@query(f"""with {PAIRS_SQL} select count(*) filter (gold <> 'supported' and pred in ('conflict', 'unsupported')) tp, count(*) filter (gold = 'supported' and pred in ('conflict', 'unsupported')) fp, count(*) filter (gold <> 'supported' and pred not in ('conflict', 'unsupported')) fn, count(*) filter (gold = 'supported' and pred = 'supported') tn,
 count(*) filter (pred = 'case_review') abstentions, count(*) filter (gold <> 'supported' and pred = 'case_review') abstentions_positive_gold, count(*) filter (gold = 'supported' and pred = 'case_review') abstentions_negative_gold, count(*) filter (gold = 'conflict' and pred = 'unsupported') conflict_to_unsupported, count(*) filter (gold = 'unsupported' and pred = 'conflict') unsupported_to_conflict from pairs""")
def binary_non_supported(spark, d):
    return pairs(spark, d).agg(*(c.alias(name) for name, c in evaluation.binary_counts().items()))


@query(f"with {PAIRS_SQL} select g, gold, case when pred = later then 'unchanged' when later = gold then 'fixed' when pred = gold then 'regressed' else 'changed_but_still_wrong' end change, count(*) n from pairs group by 1, 2, 3")
def paired_changes(spark, d):
    return pairs(spark, d).groupBy("g", "gold", metrics.change(F.col("gold"), F.col("pred"), F.col("later")).alias("change")).agg(F.count("*").alias("n"))


@query(f"with {PAIRS_SQL} select g, count(*) as \"rows\", cast(sum((gold = pred)::int) as bigint) correct, cast(sum((gold <> 'supported')::int) as bigint) gold_positive, cast(sum((pred <> 'supported')::int) as bigint) predicted_positive, sum((gold = pred)::int)::double / count(*) accuracy from pairs group by g")
def metrics_by_group(spark, d):
    cells = metrics.confusion(pairs(spark, d), ["g"])
    count = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("n"))), F.lit(0))
    positive = cells.groupBy("g").agg(count(F.col("gold") != "supported").alias("gold_positive"), count(F.col("pred") != "supported").alias("predicted_positive"))
    return metrics.overall(cells, ["g"]).join(positive, "g").select("g", "rows", "correct", "gold_positive", "predicted_positive", "accuracy")


SCORES_SQL = """s as (select l_orderkey * 10 + l_linenumber id, ((l_orderkey * 7919 + l_linenumber * 31) % 1000) / 1000.0::double e, ((l_partkey * 104729) % 1000) / 1000.0::double c, ((l_suppkey * 1299709) % 1000) / 1000.0::double p, l_linenumber from lineitem)"""
ORDER_SCORES_SQL = "s as (select o_orderkey id, ((o_orderkey * 7919) % 1000) / 1000.0::double e, ((o_custkey * 104729) % 1000) / 1000.0::double c, ((o_orderkey * 1299709 + o_custkey) % 1000) / 1000.0::double p from orders)"
TOP_SQL = "case when e >= c and e >= 0.4 then 'entailment' when c >= 0.4 then 'contradiction' else 'neutral' end"


def scores(spark, d):
    x = lambda c: (c % 1000) / F.lit(1000.0)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31).alias("e"), x(F.col("l_partkey") * 104729).alias("c"), x(F.col("l_suppkey") * 1299709).alias("p"), "l_linenumber")


@query(f"with {SCORES_SQL} select id, case when e >= 0.5 and e >= c then 'supported' when c >= 0.5 and c > e then 'conflict' else 'unsupported' end label, {TOP_SQL} top from s")
def nli_threshold_map(spark, d):
    return scores(spark, d).select("id", verdicts.nli_label(F.col("e"), F.col("c")).alias("label"), verdicts.nli_top(F.col("e"), F.col("c"), F.lit(0.4)).alias("top"))


@query(f"""with {ORDER_SCORES_SQL}, r as (select id, case when p >= 0.5 then 'supported' else 'unsupported' end support, {TOP_SQL} top from s)
select id, case when support = 'supported' and top = 'entailment' then 'supported' when support = 'unsupported' and top = 'contradiction' then 'conflict' when support = 'unsupported' and top = 'neutral' then 'unsupported' else 'case_review' end label,
 case when support = 'supported' and top = 'entailment' then 'both_support' when support = 'unsupported' and top = 'contradiction' then 'unsupported_plus_contradiction' when support = 'unsupported' and top = 'neutral' then 'both_non_support_neutral' else 'model_disagreement' end fusion_rule from r""")
def fusion(spark, d):
    x = lambda c: (c % 1000) / F.lit(1000.0)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), x(F.col("o_orderkey") * 7919).alias("e"), x(F.col("o_custkey") * 104729).alias("c"), x(F.col("o_orderkey") * 1299709 + F.col("o_custkey")).alias("p"))
    a = rows.select("id", F.when(F.col("p") >= 0.5, "supported").otherwise("unsupported").alias("support"))
    b = rows.select("id", verdicts.nli_top(F.col("e"), F.col("c"), F.lit(0.4)).alias("top"))
    label, rule = verdicts.fused(F.col("support"), F.col("top"))
    return a.join(b, "id").select("id", label.alias("label"), rule.alias("fusion_rule"))


@query(f"""with {SCORES_SQL}, r as (select id, p, l_linenumber, case when p >= 0.5 then 'supported' else 'unsupported' end support from s), f as (select id, case when support = 'supported' then p else round(1 - p, 6) end confidence, l_linenumber from r)
select id, round(confidence, 3) confidence, confidence < 0.7 low, case when l_linenumber = 1 and confidence < 0.7 then 'long_claim,low_support_confidence' when l_linenumber = 1 then 'long_claim' when confidence < 0.7 then 'low_support_confidence' else '' end reasons from f""")
def review_policy(spark, d):
    support = F.when(F.col("p") >= 0.5, "supported").otherwise("unsupported")
    rows = scores(spark, d).withColumn("confidence", verdicts.support_confidence(support, F.col("p")))
    known = F.when(F.col("l_linenumber") == 1, F.array(F.lit("long_claim"))).otherwise(F.array().cast("array<string>"))
    low, reasons = verdicts.review(known, F.col("confidence"), "support")
    return rows.select("id", F.round("confidence", 3).alias("confidence"), low.alias("low"), F.array_join(reasons, ",").alias("reasons"))


@query("select c_mktsegment, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' and c_acctbal > 0 group by all")
def prep_join_filter(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'")
    good = table(spark, d, "customer").where("c_acctbal > 0")
    return orders.join(good, orders.o_custkey == good.c_custkey).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""with a as (select o_orderkey id, o_custkey, o_orderstatus, o_orderpriority from orders), b as (select id, case when id % 97 = 0 then o_custkey + 1 else o_custkey end o_custkey, case when id % 89 = 0 then null else o_orderstatus end o_orderstatus from a where id % 101 <> 0)
select 'only_left' as rule, cast(id as varchar) as key from a where id not in (select id from b) union all select 'differs_o_custkey', cast(id as varchar) from a join b using (id) where a.o_custkey is distinct from b.o_custkey union all select 'differs_o_orderstatus', cast(id as varchar) from a join b using (id) where a.o_orderstatus is distinct from b.o_orderstatus""")
def result_violations(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    b = a.where("id % 101 <> 0").select("id", F.when(F.col("id") % 97 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(F.col("id") % 89 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return checks.compared(a, b, "id", ["o_custkey", "o_orderstatus"], repeated=False)


@query("with a as (select distinct l_partkey k from lineitem where l_returnflag = 'A'), b as (select distinct l_partkey k from lineitem where l_returnflag = 'R') select k from a intersect select k from b")
def overlap_leakage(spark, d):
    lines = table(spark, d, "lineitem")
    part = lambda flag: lines.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"))
    return audit.leakage(part("A"), part("R"), "k").select(F.col("key").cast("long").alias("k"))
