"""Pools, choices, orders, sweeps and annotated evidence."""

from pyspark.sql import functions as F

from plumbline.operators import experiments

TEXTS = {"a": "The mill is old. " * 20 + "It stands by the river.", "b": "Barges pass at noon."}


def contexts(spark):
    return spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate(TEXTS.items(), 1)], "g int, pos int, id string, text string")


def test_pool_and_its_violations(spark):
    rows = experiments.pool(contexts(spark), "g", 32).orderBy("pos")
    got = rows.collect()
    assert [r.pos for r in got] == list(range(1, len(got) + 1)) and got[0].chunk_id == "a_c001" and got[-1].chunk_id == "b_c001"
    assert all(TEXTS[r.source_id][r.start : r.end] == r.text and r.token_count <= 32 for r in got)
    assert experiments.pool_violations(rows, contexts(spark), "g").count() == 0
    worse = rows.withColumns({"text": F.when(F.col("pos") == 1, "x").otherwise(F.col("text")), "end": F.when(F.col("pos") == 2, 9999).otherwise(F.col("end")), "source_id": F.when(F.col("pos") == 3, "z").otherwise(F.col("source_id")), "chunk_id": F.when(F.col("pos") == 2, "a_c001").otherwise(F.col("chunk_id"))})
    broken = {(r.rule, r.key) for r in experiments.pool_violations(worse, contexts(spark), "g").collect()}
    assert broken >= {("text", "1/a_c001"), ("offsets", "1/a_c001"), ("unknown_source", "1/a_c003"), ("duplicate_key", "1/a_c001")}
    turned = rows.withColumn("pos", -F.col("pos"))
    assert {r.rule for r in experiments.pool_violations(turned, contexts(spark), "g").collect()} == {"order"}


def test_scores_by_chance_depend_on_query_and_place_only(spark):
    rows = spark.createDataFrame([(q, p) for q in (1, 2) for p in (1, 2)], "qid int, pos int")
    one = {(r.qid, r.pos): r.score for r in experiments.random_scores(rows, 3).collect()}
    assert one == {(r.qid, r.pos): r.score for r in experiments.random_scores(rows.repartition(3), 3).collect()} and len(set(one.values())) == 4
    assert one != {(r.qid, r.pos): r.score for r in experiments.random_scores(rows, 4).collect()}


def test_orders_hold_the_same_chunks(spark):
    candidates = spark.createDataFrame([(1, p, f"k{p}", f"text {p}") for p in (1, 2, 3)] + [(2, 1, "k1", "t")], "qid int, pos bigint, chunk_id string, text string")
    choices = spark.createDataFrame([(1, "v", [3, 1]), (2, "v", [1])], "qid int, variant string, chosen array<bigint>")
    got = {r.qid: r for r in experiments.both_orders(experiments.chosen_chunks(choices, candidates)).collect()}
    assert got[1].rank_ids == ["k3", "k1"] and got[1].source_ids == ["k1", "k3"] and got[1].order_changed and not got[2].order_changed
    assert got[1].rank_document == "[Evidence k3]\ntext 3\n\n[Evidence k1]\ntext 1" and got[1].rank_tokens == got[1].source_tokens == 12


def test_sweep_and_its_comparisons(spark):
    ranked = spark.createDataFrame([(1, "bm25", p, r) for p, r in ((1, 2), (2, 4), (3, 1), (4, 3))], "qid int, variant string, pos int, rank int")
    got = {r.variant: (r.selected, r.actual_k, r.candidate_shortfall) for r in experiments.k_sweep(ranked).collect()}
    assert got == {"bm25_k1": ([3], 1, False), "bm25_k3": ([1, 3, 4], 3, False), "bm25_k5": ([1, 2, 3, 4], 4, True)}
    pairs = experiments.sweep_comparisons()
    assert len(pairs) == len(set(pairs)) == 13 and pairs[-1] == ("full_source", "full_chunked_source")


def test_annotations(spark):
    kind = "g int, case int, requirement string, source_id string, quote string, claim string, gold_label string"
    marks = [(1, 5, "r1", "b", "a", "c", "supported"), (1, 5, "r1", "a", "river", "c", "supported"), (1, 6, "r1", "a", "sea", "changed", "conflict"), (1, 7, "r2", "z", "", "c", "supported")]
    marks = spark.createDataFrame(marks, kind)
    places = {(r.case, r.source_id, r.start, r.end) for r in experiments.annotated_spans(marks, contexts(spark), "g").collect()}
    assert places == {(5, "b", 1, 2), (5, "b", 8, 9), (5, "b", 12, 13), (5, "a", 357, 362)}
    pairs = spark.createDataFrame([(5, "c", "supported"), (6, "c", "supported")], "pair_id int, claim string, gold_label string")
    got = {(r.rule, r.key) for r in experiments.annotation_violations(marks, pairs, contexts(spark), "g").collect()}
    assert got == {("claim_changed", "6/r1"), ("label_changed", "6/r1"), ("quote_missing", "6/r1"), ("unknown_pair", "7/r2"), ("quote_missing", "7/r2")}


def test_retention_by_variant(spark):
    spans = spark.createDataFrame([(1, 5, "r1", "a", 0, 8, "The mill"), (1, 5, "r1", "b", 0, 6, "Barges"), (1, 5, "r2", "a", 9, 11, "is")], "g int, case int, requirement string, source_id string, start int, end int, text string")
    chosen = [("x", 1, "b", 0, 20), ("x", 1, "a", 9, 20), ("y", 1, "a", 0, 3), ("y", 1, "a", 4, 8)]
    variants = spark.createDataFrame([(1, v) for v in "xyz"], "g int, variant string")
    got = {r.variant: (r.met, r.asked, r.complete) for r in experiments.variant_retention(spans, spark.createDataFrame(chosen, "variant string, g int, source_id string, start int, end int"), "g", variants).collect()}
    assert got == {"x": (2, 2, True), "y": (1, 2, False), "z": (0, 2, False)}


def test_truncation_cuts_the_longer_first(spark):
    rows = spark.createDataFrame([(1, "w " * 20, "c " * 3), (2, "w " * 6, "c " * 20), (3, "w " * 20, "c " * 20)], "k int, document string, claim string")
    got = {r.k: (r.tokens, r.truncated_12, r.document_kept_12, r.claim_kept_12) for r in experiments.truncation(rows, (12, 100)).collect()}
    assert got == {1: (25, True, 7, 3), 2: (28, True, 5, 5), 3: (42, True, 5, 5)}


def test_exported_cases(spark):
    cases = spark.createDataFrame([(1, "kind", "river")], "pair_id int, category string, anchor string")
    verdicts = spark.createDataFrame([(1, "full", "by the river", "supported", False), (1, "cut", "by the", "conflict", True), (2, "full", "river", "supported", False)], "pair_id int, variant string, document string, pred string, review_flag boolean")
    assert {r.variant: (r.anchor_present, r.anchor_at) for r in experiments.exported_cases(cases, verdicts).collect()} == {"full": (True, 7), "cut": (False, None)}
