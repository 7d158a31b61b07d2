"""Interval joins and searches for quotes against all pairs, and keys with very many rows."""

import random

from pyspark.sql import functions as F

from plumbline.operators import claims, pairs, quotes, spans


def test_interval_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    draw = lambda n: [(rng.choice(["a", "b", None]), s := rng.randrange(90), s + rng.randrange(40), i) for i in range(n)] + [("a", None, 5, -1), ("a", 5, None, -2)]
    a, b = draw(60), draw(60)
    left, right = spark.createDataFrame(a, "k string, s int, e int, i int"), spark.createDataFrame(b, "k string, t int, f int, j int")
    sound = lambda x: [r for r in x if None not in r]
    want = sorted((x[3], y[3]) for x in sound(a) for y in sound(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    for width in (1, 7, 512):
        assert sorted((r.i, r.j) for r in spans.interval_pairs(left, right, "k", ("s", "e"), ("t", "f"), width).collect()) == want


def test_a_document_with_very_many_statements_and_spans(spark):
    a = spark.range(100_000).select(F.lit("d").alias("k"), (F.col("id") * 20).alias("s"), (F.col("id") * 20 + 18).alias("e"))
    b = spark.range(100_000).select(F.lit("d").alias("k"), (F.col("id") * 20 + 10).alias("t"), (F.col("id") * 20 + 25).alias("f"))
    found = spans.interval_pairs(a, b, "k", ("s", "e"), ("t", "f"))
    assert found.count() == 199_999
    assert spans.shared_chars(a.toDF("k", "span_start", "span_end"), b.toDF("k", "span_start", "span_end"), "k").first().shared == 100_000 * 8 + 99_999 * 5


def test_spans_of_statements(spark):
    rng = random.Random(3)
    kind = f"k int, t string, marks array<{pairs.SPAN}>"
    rows = [(i, "".join(rng.choice(["ja", " ", ". ", "\n", "x", "- "]) for _ in range(40)), [(s := rng.randrange(50), s + rng.randrange(1, 30), None, str(n)) for n in range(rng.randrange(9))] if i % 5 else None) for i in range(60)]
    rows += [(100, "One. Two.", [(0, 99, None, "all"), (None, 3, None, "null"), (-5, 1, None, "early"), (3, 3, None, "none")])]
    got = claims.split_claims(spark.createDataFrame(rows, kind), "k", "t", spans="marks").collect()
    assert len(got) > 100
    marks = {k: m or [] for k, _, m in rows}
    for r in got:
        want = [m[3] for m in marks[r.k] if None not in m[:2] and m[0] < r.claim_end and r.claim_start < m[1]]
        assert [s.label_type for s in r.spans] == want


def test_quotes_equal_a_plain_search(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab€\U0001f600") for _ in range(n))
    texts = [("x", 1, text(300)), ("x", 2, text(50)), ("y", 1, None), ("z", 1, ""), (None, 1, "ab")]
    asked = [(k, i, text(rng.randrange(4))) for k, i, _ in texts for _ in range(40)] + [("x", 1, None), ("nowhere", 1, "a")]
    kind = "k string, i int, {} string"
    want = sorted({(k, i, q, at) for k, i, q in asked if q for a, b, t in texts if (a, b) == (k, i) and k and t for at in range(len(t)) if t.startswith(q, at)})
    for size in (3, 1000):
        got = quotes.quote_places(spark.createDataFrame(asked, kind.format("quote")), spark.createDataFrame(texts, kind.format("text")), ["k", "i"], size=size)
        assert sorted(map(tuple, got.collect())) == want


def test_a_source_with_many_quotes_is_read_a_few_times(spark):
    asked = spark.range(5000).select(F.lit("s").alias("k"), F.concat(F.lit("q"), F.col("id"), F.lit(".")).alias("quote"))
    texts = asked.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("quote")), " ").alias("text"))
    got = quotes.quote_places(asked, texts, ["k"])
    assert got.agg(F.count("*"), F.count_distinct("place")).first()[:] == (5000, 5000)
