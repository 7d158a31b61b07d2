"""Choices under a real tokenizer's counts against encoding the whole document for each trial."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.operators import budgets
from plumbline.plans import answers, catalog, evidence

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(text):
    return len(budgets.cutter(PATH).tokenizer.encode(text, add_special_tokens=False).ids)


def noise(rng, n):
    return "".join(rng.choice(["a", " ", "\n", "'", "l", "s", "word", "12", "é", "…", "[", "]", "  \n", "ll", "<|endoftext|>", "字", "x" * 40]) for _ in range(rng.randrange(n)))


def test_seams_equal_whole_documents():
    rng, cut = random.Random(4), budgets.cutter(PATH)
    for _ in range(1500):
        text = "[Evidence a]\n" + noise(rng, rng.choice([4, 60]))
        told = budgets.profile(text, cut)
        assert told.tokens == whole(text)
        for _ in range(3):
            more = rng.choice(["[Evidence b]\n", ""]) + noise(rng, rng.choice([4, 60]))
            text += "\n\n" + more
            try:
                told = budgets.joined(told, budgets.profile(more, cut), cut)
            except ValueError:
                assert not more.startswith("[Evidence")  # told, not miscounted
                break
            assert told.tokens == whole(text), text


def greedy(pool, claim, budget, k):
    chosen = []
    for pos, block in pool:
        trial = [*chosen, (pos, block)]
        if whole("\n\n".join(b for _, b in trial)) + whole(claim) + 2 <= budget:
            chosen = trial
        if len(chosen) == k:
            break
    return [p for p, _ in chosen], whole("\n\n".join(b for _, b in chosen)) + whole(claim) + 2


def test_choices_equal_brute_force(spark):
    texts = {(r.conv_id, r.pos): f"[Evidence {r.doc_id}]\n{r.text}" for r in answers.contexts(spark, SF).collect()}
    asked = {r.qid: (r.conv_id, r.query or "") for r in answers.responses(spark, SF).collect()}
    pools = {}
    for r in evidence.scored_candidates(spark, SF).collect():
        pools.setdefault((r.qid, r.variant), []).append((-r.score, r.pos))
    got = catalog.queries()["budget_tokens"](spark, SF).collect()
    assert len(got) == len(pools) and any(r.chosen.count(",") == 2 for r in got)
    for r in got:
        conv, claim = asked[r.qid]
        chosen, used = greedy([(p, texts[conv, p]) for _, p in sorted(pools[r.qid, r.variant])], claim, 512, 3)
        assert (r.chosen, r.candidates) == (",".join(map(str, chosen)), len(pools[r.qid, r.variant])) and (not chosen or r.input_tokens == used)
        assert r.status == ("ok" if chosen else "nothing_fits")


def test_odd_pools(spark):
    rows = [("a", "v", 1, 1.0, "x"), ("a", "v", 2, None, "y"), ("b", "v", 1, float("nan"), "z"), ("c", "v", 1, 0.5, None), ("c", "v", 2, 0.5, "tie"), (None, "v", 1, 0.5, "n")]
    df = spark.createDataFrame(rows, "qid string, variant string, pos int, score double, text string")
    cut = budgets.profiles(df, ["qid", "pos"], "text", PATH).select(F.col("qid").alias("q"), F.col("pos").alias("p"), "profile")
    scored = df.join(cut, df.qid.eqNullSafe(cut.q) & (df.pos == cut.p)).withColumn("claim_tokens", F.lit(3))
    got = {r.qid: (r.candidates, r.chosen, r.status) for r in budgets.exact_choice(scored, PATH).collect()}
    assert got == {"a": (2, [], "bad_score"), "b": (1, [], "bad_score"), "c": (2, [1, 2], "ok"), None: (1, [1], "ok")}
    assert budgets.exact_choice(scored.where("false"), PATH).count() == 0
    with pytest.raises(ValueError, match="rewrites"):
        budgets.Cutter(public_tokenizers.path("word_bpe_49k.json"))
