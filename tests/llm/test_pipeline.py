"""The pipeline stage by stage."""

import corpus_pipeline
from pyspark.sql import functions as F

from plumbline.llm import decontam, hostrules, widedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        was, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == was.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if i == 0:
            assert ids == {r.doc_id for r in hostrules.judge(was).where("kept").collect()}
        elif i == 1:
            assert ids == {r.component_id for r in widedup.similar_documents(was).collect()} and docs.count() == len(ids)
        elif i == 2:
            found = decontam.leak_digest(decontam.find_leaks(was, spark.read.parquet(f"{SF}/benchmark.parquet")))
            assert ids >= {r.doc_id for r in found.where("not contaminated").collect()}
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        elif i == 3:
            assert ids == {r.doc_id for r in was.collect()} and docs.count() >= was.count()
        else:
            rows = docs.orderBy("start").collect()
            assert docs.count() == was.count() and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_run_names_all_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicate removal", "benchmark decontamination", "temperature mixing", "token output"]


def test_stages_keep_their_ways_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty tables, and columns named like what the stages use."""
    odd = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    clash = "copy block n_tokens row text_ host h no_host m doc clean fp key id __src __clean".split()
    more = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (2, "a b " * 30, "x", None, None)], odd.schema)
    odd = odd.unionByName(more).select("*", *(F.lit(f"mine {c}").alias(c) for c in clash))
    for name, docs in (("odd", odd), ("none", odd.where("false"))):
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, SF).write.parquet(str(tmp_path / f"{name}{i}"))
            was, docs = docs, spark.read.parquet(str(tmp_path / f"{name}{i}"))
            if i < 4:
                assert docs.columns == was.columns, stage
                assert docs.where(" or ".join(f"`{c}` is distinct from 'mine {c}'" for c in clash)).count() == 0, stage
            assert (docs.count() > 0) == (name == "odd")
