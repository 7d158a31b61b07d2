"""Queries whose SQL would be too slow or is fixed to less, by brute force over the whole pool."""

import numpy as np
import pytest
from plumbline.operators import experiments, ranking
from plumbline.operators.chunks import TOKEN
from plumbline.plans import answers, catalog, evidence

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [ranking.DENSE_BLOCK, 60])  # one block, and several
def test_every_vector_meets_all_others(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "DENSE_BLOCK", block)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    cosine = np.round(v @ v.T / np.sqrt(np.outer((v * v).sum(1), (v * v).sum(1))), 4)
    np.fill_diagonal(cosine, -np.inf)
    want = {(int(ids[q]), int(ids[c]), n, round(cosine[q, c], 4)) for q in range(len(ids)) for n, c in enumerate(np.argsort(-cosine[q], kind="stable")[:5], 1)}
    got = {(r.qv, r.vec_id, r["rank"], round(r.score, 4)) for r in catalog.queries()["dense_rank_topk"](spark, SF).collect()}
    assert got == want and any(q % 50 != c % 50 for q, c, _, _ in got)


def test_vectors_without_cosine(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 2.0])], "id long, v array<float>")
    got = sorted((r.qv, r["rank"], r.id) for r in ranking.dense_topk(rows, "id", "v", 5).collect())
    assert got == [(1, 1, 2), (1, 2, 5), (2, 1, 1), (2, 2, 5), (5, 1, 2), (5, 2, 1)]
    assert ranking.dense_topk(rows.where("id = 9"), "id", "v", 5).count() == 0


def test_contexts_are_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert answers.contexts(spark, SF).count() == docs.count()


def test_budget_counts_header_text_and_claim(spark):
    """The choice against a walk over every ranking."""
    cost = {(r.qid, r.pos): len(TOKEN.findall(f"[Evidence {r.chunk_id}]\n{r.text}")) for r in evidence.candidates(spark, SF).collect()}
    asked = {r.qid: len(TOKEN.findall(r["query"] or "")) for r in answers.responses(spark, SF).collect()}
    pools = {}
    for r in evidence.scored_candidates(spark, SF).collect():
        pools.setdefault((r.qid, r.variant), []).append((-r.score, r.pos))
    got = {(r.qid, r.variant): (r.input_tokens, r.chosen) for r in catalog.queries()["budget_select"](spark, SF).collect()}
    assert got.keys() == pools.keys()
    for (qid, variant), pool in pools.items():
        used, chosen = asked[qid] + 2, []
        for _, pos in sorted(pool):
            if len(chosen) < 3 and used + cost[qid, pos] <= 512:
                used, chosen = used + cost[qid, pos], [*chosen, pos]
        assert got[qid, variant] == (used, ",".join(map(str, chosen)))


def test_budget_tells_what_cannot_be_chosen(spark):
    rows = [(1, "a", 1, 1.0, 600, 3), (2, "a", 1, float("nan"), 5, 3), (2, "a", 2, 1.0, 5, 3), (3, "a", 1, 2.0, 600, 3), (3, "a", 2, 1.0, 20, 3)]
    got = experiments.budget_choice(spark.createDataFrame(rows, "qid int, variant string, pos int, score double, cost int, claim_tokens int")).collect()
    assert {r.qid: (r.status, r.chosen, r.input_tokens) for r in got if r.qid != 2} == {1: ("nothing_fits", [], 5), 3: ("ok", [2], 25)}
    assert [(r.status, r.chosen) for r in got if r.qid == 2] == [("bad_score", [])]
