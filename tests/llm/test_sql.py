"""The corpus queries that have SQL against it, also where hosts are bad and rows are null or repeat."""

import pytest
from compare import differ

from plumbline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert not differ(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_quality_of_bad_hosts_equals_sql(spark, tmp_path):
    good = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, good if i % 7 else "too short", "good") for i in range(300)]
    rows += [(1000 + i, "again and again and again and " * 9 if i else good, "bad") for i in range(200)]
    rows += [(2000, None, None), (2000, good, None), (2001, "", "one"), (2001, "a\nb\na\n\n#$ é", "one"), (None, good, "good")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*.parquet")
    file.rename(tmp_path / "documents.parquet")
    got = queries.op5_host_quality(spark, str(tmp_path))
    assert [r.kept for r in got.where("doc_id = 1000").collect()] == [False]
    assert not differ(got, queries.oracle_sql()["op5_host_quality"], str(tmp_path))
