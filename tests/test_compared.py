"""Two tables compared in one grouping against the separate checks, with repeated keys, null keys and null fields."""

import pytest
from plumbline.operators import checks
from plumbline.plans.judging import evaluation_violations


@pytest.mark.parametrize("task_rows", [1, 1 << 20])
def test_compared_equals_the_separate_checks(spark, monkeypatch, task_rows):
    monkeypatch.setattr(checks, "TASK_ROWS", task_rows)
    schema = "id long, key string, f1 array<int>"
    a = spark.createDataFrame([(1, "x", [1]), (2, None, [1]), (3, "y", None), (4, "z", [2]), (5, "a", [1]), (5, "b", [1]), (5, "a", [1]), (6, "c", [3]), (6, "c", [3]), (None, "n", [0]), (None, "n", [0]), (8, "only", [1])], schema)
    b = spark.createDataFrame([(1, "x", [1]), (2, "t", [1]), (3, "y", None), (4, "z", None), (5, "a", [1]), (5, "a", [9]), (7, "d", [1]), (7, "d", [1]), (None, "n", [0]), (9, None, None)], schema)
    fields = ["key", "f1"]
    parts = [checks.key_differences(a, b, "id"), checks.field_differences(a, b, "id", fields)]
    told = lambda df: sorted(((r.rule, r.key) for r in df.collect()), key=str)
    assert told(checks.compared(a, b, "id", fields, repeated=False)) == told(checks.union(parts))
    assert told(checks.compared(a, b, "id", fields)) == told(checks.union([*parts, checks.duplicates(a, "id"), checks.duplicates(b, "id")]))
    assert told(checks.compared(a, b.where("false"), "id", [], repeated=False)) == told(checks.key_differences(a, b.where("false"), "id"))


def test_tasks_grow_with_the_table(spark, monkeypatch, tmp_path):
    """The table that is compared is dealt to a task for each ``TASK_ROWS`` rows."""
    monkeypatch.setattr(checks, "TASK_ROWS", 50)
    dealt = []
    monkeypatch.setattr(checks, "written", lambda df, name: dealt.append(df.rdd.getNumPartitions()) or df)
    spark.range(1, 1001).selectExpr("id o_orderkey", "id % 7 o_custkey", "'F' o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    evaluation_violations(spark, str(tmp_path)).count()
    assert dealt == [40]
