"""Places in files of unequal size and in split files, results against rows, digests, and draws against Python's own."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import digests, draws, judges
from plumbline.plans import catalog
from plumbline.sources import lines

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """Three rows in the first file, many in the second, blank lines in both; read in splits of 2 KB."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k": 0}\n\n{"k": 1}\n{"k": 2}\n')
    (tmp_path / "in/b.json").write_text("".join(f'{{"k": {i}, "x": "{"y" * (i % 50)}"}}\n' + "\n" * (i % 3 == 0) for i in range(3, 3000)))
    (tmp_path / "in/c.json").write_text('{"k": 3000}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    yield str(tmp_path / "in")
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_in_files(spark, folder):
    got = lines.numbered_records(spark, folder, "k int, x string")
    assert got.rdd.getNumPartitions() > 5
    rows = sorted((r.ordinal, r.k) for r in got.collect())
    assert rows == [(i, i) for i in range(3001)]
    assert {r.k: r.line for r in got.where("k in (0, 1, 2, 3, 4, 3000)").collect()} == {0: 1, 1: 3, 2: 4, 3: 1, 4: 3, 3000: 1}
    assert sorted(r.k for r in lines.first_records(spark, folder, "k int", 5).collect()) == [0, 1, 2, 3, 4]
    assert lines.first_records(spark, folder, "k int", 0).count() == 0 and lines.first_records(spark, folder, "k int", 9999).count() == 3001
    first = lines.first_records(spark, folder, "k int", 2)
    assert all("b.json" not in f for f in first.inputFiles())


def test_lines_that_are_no_records(spark, folder):
    with open(folder + "/c.json", "w") as f:
        f.write('\n{"k": 1\n{"k": 2}')
    assert [(r.file[-6:], r.line, r.text) for r in lines.malformed(spark, folder, "k int").collect()] == [("c.json", 2, '{"k": 1')]
    with pytest.raises(Exception, match="c.json line 2"):
        lines.numbered_records(spark, folder, "k int").collect()


def test_results_against_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("ordinal"), F.when(F.col("id") != 9, F.col("id") * 3).alias("k"))
    lines.check_prefix(rows, rows.where("ordinal < 3000"), ["k"])
    with pytest.raises(ValueError, match="line 41 differs in k"):
        lines.check_prefix(rows, rows.withColumn("k", F.when(F.col("ordinal").isin(40, 4000), 1).otherwise(F.col("k"))), ["k"])
    with pytest.raises(ValueError, match="line 5001 differs in more_results"):
        lines.check_prefix(rows, rows.union(spark.createDataFrame([(5000, 1)], "ordinal long, k long")), ["k"])


def test_ordered_digests(spark):
    rows = spark.range(3000).select(F.col("id").alias("ordinal"), F.when(F.col("id") != 9, F.col("id") * 3).alias("k"))
    level = [hashlib.sha256(json.dumps({"k": None if i == 9 else i * 3}, separators=(",", ":")).encode()).hexdigest() for i in range(3000)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 100]).encode()).hexdigest() for i in range(0, len(level), 100)]
    assert digests.ordered_digest(rows.repartition(5), "ordinal", ["k"], 100) == level[0]
    swap = rows.withColumn("ordinal", F.when(F.col("ordinal") == 7, 8).when(F.col("ordinal") == 8, 7).otherwise(F.col("ordinal")))
    assert digests.ordered_digest(swap, "ordinal", ["k"], 100) != level[0] and digests.ordered_digest(rows.where("false"), "ordinal", ["k"]) == ""
    found = digests.prefix_blocks(rows, swap.where("ordinal < 2750"), "ordinal", ["k"], 100).collect()
    assert [r.block for r in found] == [0]
    assert digests.prefix_blocks(rows, rows.where("ordinal < 2750"), "ordinal", ["k"], 100).isEmpty()
    assert [r.block for r in digests.prefix_blocks(rows.where("ordinal < 2000"), rows, "ordinal", ["k"], 1000).collect()] == [2]


def test_changes_of_tables(spark):
    old = spark.range(2000).select((F.col("id") % 1000).alias("k"), F.lit("x").alias("v")).union(spark.createDataFrame([(None, None), (5000, "gone")], "k long, v string"))
    new = old.where("k is null or k not in (5000)").withColumn("v", F.when(F.col("k") == 3, "y").otherwise(F.col("v"))).union(spark.createDataFrame([(4, "x"), (6000, "new")], "k long, v string"))
    got = {r.k: (r.change, r.n_old, r.n_new) for r in digests.changes(old, new, ["k"], ["v"], 64).collect()}
    assert got == {5000: ("missing", 1, 0), 3: ("changed", 2, 2), 4: ("doubled", 2, 3), 6000: ("added", 0, 1)}
    assert digests.changes(old, old.repartition(3), ["k"], ["v"]).isEmpty() and digests.changes(old.where("false"), old.where("false"), ["k"], ["v"]).isEmpty()


def test_draws_equal_those_of_python(spark):
    got = {}
    for r in sorted(catalog.queries()["random_draws"](spark, SF).collect()):
        got.setdefault(r.conv_id, []).append(r.score)
    assert got
    for key, scores in got.items():
        own = random.Random(int.from_bytes(hashlib.sha256(f"42:{key}".encode()).digest(), "big"))
        assert scores == [own.random() for _ in scores]


def test_large_and_odd_pools(spark):
    pool = spark.range(9000).select(F.lit("p").alias("key"), F.col("id").alias("chunk")).union(spark.createDataFrame([(None, 0), ("q", 0), ("r", None)], "key string, chunk long"))
    got = draws.pool_draws(pool, "key", "chunk", 7)
    own = draws.generator(7, "p")
    assert [r.score for r in got.where("key = 'p'").orderBy("chunk").collect()] == [own.random() for _ in range(9000)]
    rest = {r.key: r.score for r in got.where("key is null or key <> 'p'").collect()}
    assert rest == {None: None, "q": draws.generator(7, "q").random(), "r": None}


@pytest.mark.parametrize("n", [0, 5, 100, 200])
def test_samples_equal_those_of_python(spark, n):
    df = spark.range(200).select((1000 - F.col("id")).alias("k"), F.lit(1).alias("drawn_"))
    got = draws.exact_sample(df.repartition(3), n, 42, ["k"]).orderBy("drawn").collect()
    assert [r.k for r in got] == random.Random(42).sample(list(range(801, 1001)), n)
    with pytest.raises(ValueError, match="201 rows are asked for"):
        draws.exact_sample(df, 201, 42, ["k"])


def test_batches_keep_rows_without_a_number(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (1,), (10**15,)], "k long")
    got = sorted((r.batch_id, r.batch_size, str(r.k)) for r in judges.numbered_batches(df, "k", 2).collect())
    assert [(b, n) for b, n, _ in got] == [("b00001", 2)] * 2 + [("b00002", 2)] * 2 + [("b00003", 1)] and got[-1][2] == str(10**15) and ("b00001", 2, "None") in got


def test_a_sign_inside_a_passage(spark):
    from plumbline.functions.text import passages

    df = spark.createDataFrame([("passage 1: a\x02b\x01c\nPassage 2 : d",), ("e\x02f",), ("intro\npassage 7: g",)], "t string")
    assert [[tuple(p) for p in r[0]] for r in df.select(passages(F.col("t"))).collect()] == [[("passage_1", "a\x02b\x01c"), ("passage_2", "d")], [("passage_1", "e\x02f")], [("passage_7", "g")]]
