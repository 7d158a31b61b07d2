"""Numbers of rows, and the folder that jobs share."""

from pyspark.sql import functions as F

from plumbline.operators.places import numbered
from plumbline.sources import scratch


def test_rows_are_numbered_in_groups(spark):
    rows = [(g, k) for g in ("a", None, "b") for k in (3, 1, None, 2, 2)] + [("hot", 7)] * 1000
    df = spark.createDataFrame(rows, "g string, place int").repartition(5)
    got = numbered(df, ["place"], ["g"], place="no", total="of").collect()
    assert len(got) == len(rows) and {r.of for r in got if r.g == "hot"} == {1000}
    for g in ("a", None, "b"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.no)
        assert [r.no for r in mine] == [0, 1, 2, 3, 4] and [r.place for r in mine] == [None, 1, 2, 2, 3] and {r.of for r in mine} == {5}
    assert sorted(r.no for r in got if r.g == "hot") == list(range(1000))


def test_rows_are_numbered_without_groups(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = numbered(df, ["k"]).orderBy("k").collect()
    assert [r.place for r in got] == list(range(5000))
    assert numbered(df.where("false"), ["k"]).count() == 0


def test_equal_values_go_to_many_tasks(spark):
    got = numbered(spark.range(20000).select(F.lit(1).alias("k")), ["k"])
    assert got.agg(F.count_distinct("place"), F.max("place")).first()[:] == (20000, 19999)


def test_a_session_without_a_shared_folder(spark, monkeypatch):
    monkeypatch.setitem(spark.__dict__, "conf", type("Conf", (), {"get": lambda self, key, default=None: default})())
    path = scratch.shared_dir(spark)
    assert path == scratch.shared_dir(spark) == scratch._own[spark.sparkContext.applicationId]
    df = scratch.written(spark.range(3), "t")
    assert df.count() == 3
