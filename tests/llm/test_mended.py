"""Rows that repeat an id, wide fingerprints, ties, and models against naive ones."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hostrules, langid, mixing, neardup, tokenout, widedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("order", [("text",), ("doc_id", "text"), ("note",)])
def test_rows_that_share_an_id_keep_their_texts(spark, order):
    rows = [(5, "A", "z"), (5, "B", "y"), (3, "B", "x"), (None, "C", "w"), (7, "D", "b"), (7, "D", "a"), (None, "B", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").orderBy(*order)
    assert sorted(map(tuple, neardup.first_of_each(docs).collect()), key=str) == [(3, "B", "x"), (5, "A", "z"), (7, "D", "a"), (None, "C", "w")]


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_wide_groups_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(4000)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        texts.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    texts += [None, "", " ", "one", "one"]
    got = {r.doc_id: r.component_id for r in widedup.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t or "") for t in texts]
    near = found = 0
    for a in range(420):
        for b in range(a):
            similarity = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            near += similarity >= 0.8
            found += similarity >= 0.8 and got[a] == got[b]
            assert similarity > 0 or got[a] != got[b]
    assert near > 500 and found >= 0.97 * near
    assert got[420] == got[421] == got[422] == 420 and got[423] == got[424] == 423


@pytest.mark.parametrize("block", [1 << 17, 64])
def test_large_keys_of_wide_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(6)
    base = [rng.randrange(1 << 4000) for _ in range(2)]
    texts = []
    for b in base:
        words = [str(b >> 13 * i & 8191) for i in range(250)]
        for i in range(300):
            near = list(words)
            near[i % 250] = f"x{i}"
            texts.append(" ".join(near))
    got = [r.component_id for r in widedup.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [0] * 300 + [300] * 300


def test_repeated_ids_are_written_in_the_order_of_their_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b b b"), (1, None), (1, "a"), (0, "c c")], "doc_id long, text string")
    for i, rows in enumerate((docs, docs.orderBy("text"), docs.repartition(3))):
        tokenout.write_ids(rows, str(tmp_path / str(i)), public_tokenizers.path("byte_bpe_50k.json"))
        got = tokenout.digest(tokenout.read_ids(spark, str(tmp_path / str(i)))).orderBy("start").collect()
        assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(0, 0, 3), (1, 3, 1), (1, 4, 2), (1, 6, 4)]


def test_settled_code_points_are_cut_as_the_library_does():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenout.load_tokenizer(path)
    points = [chr(c) for c in range(0x3000) if not tokenout.SETTLED.search(chr(c))]
    texts = [x for c in points for x in (f"a{c}b", f"1{c}2 ", f" {c} .", c + c, f"a  {c} \n")]
    flat, ends = tokenout.encoder(path, tokenout.rank_table(path))(texts)
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_hosts_go_when_surely_bad(spark):
    good, bad = " ".join(f"w{j}" for j in range(20)), "too short"
    rows = [("large", bad if i % 10 < 6 else good) for i in range(500)] + [("small", bad if i < 3 else good) for i in range(5)]
    rows += [(f"h{h}", bad if i == 0 else good) for h in range(40) for i in range(20)]
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    kept = {r.source: r.n for r in docs.join(hostrules.judge(docs).where("kept"), "doc_id").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert "large" not in kept and kept["small"] == 2 and kept["h0"] == 19
    assert hostrules.keep_good(docs).count() == sum(kept.values())


def naive_kneser_ney(texts, alphabet):
    """Interpolated Kneser-Ney by the book, with dictionaries."""
    grams = [Counter() for _ in range(4)]
    for t in texts:
        t = "^^^" + t
        grams[3].update(t[i - 3 : i + 1] for i in range(3, len(t)))
    for n in (2, 1, 0):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    discounts, heads = [], []
    for g in grams:
        n1, n2 = sum(x == 1 for x in g.values()), sum(x == 2 for x in g.values())
        discounts.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
        by = defaultdict(list)
        for k, x in g.items():
            by[k[:-1]].append(x)
        heads.append(by)

    def p(context, c, n=3):
        if n < 0:
            return 1 / (alphabet + 1)
        xs = heads[n].get(context)
        if not xs:
            return p(context[1:], c, n - 1)
        return max(grams[n][context + c] - discounts[n], 0) / sum(xs) + discounts[n] * len(xs) / sum(xs) * p(context[1:], c, n - 1)

    return p


def test_model_equals_naive_kneser_ney(spark):
    rng = random.Random(9)
    said = {"xx": ["".join(rng.choices("abcd ef", k=80)).strip() for _ in range(30)], "yy": ["".join(rng.choices("aeiou rst", k=60)).strip() for _ in range(40)]}
    said = {k: [" ".join(t.split()) for t in v] for k, v in said.items()}
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, v in said.items() for t in v)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    alphabet = len({c for v in said.values() for t in v for c in t})
    tests = ["abc fed", "rat tie", "qqq", "a"]
    h, _ = model.cross_entropies(tests)
    for j, k in enumerate(model.langs):
        p = naive_kneser_ney(said[k], alphabet)
        for t, got in zip(tests, h[:, j]):
            s = "^^^" + t
            assert got == pytest.approx(-sum(math.log(p(s[i - 3 : i], s[i])) for i in range(3, len(s))) / len(t), rel=1e-4)


def test_null_ids_train_and_predict(spark):
    rows = [(None, "xx", "abc def abc"), (None, "yy", "uvw xyz uvw"), (None, None, "abc"), (None, "xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs)
    assert sorted(r.lang_pred for r in langid.predict(docs, model).collect()) == ["und", "xx", "xx", "yy"]


def test_mixing_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choices(["a", "b", "c", None], [50, 20, 5, 1])[0], rng.randint(0, 100)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    tokens = {i: n for i, _, n in rows}
    total = Counter()
    for i, s, _ in rows:
        total[s] += tokens[i]
    top, low = max(total.values()), min(total.values())
    a = 1 + math.log(1.25) / math.log(low / top)  # the smallest source is repeated 1.25 times
    places = {r.doc_id: (r.source, r.order, r.block, r.rank) for r in docs.select("doc_id", "source", F.pmod(F.xxhash64("doc_id", F.lit(mixing.SEED)), F.lit(mixing.BLOCKS)).cast("int").alias("block"), F.xxhash64("doc_id", F.lit(mixing.SEED + 1)).alias("rank"), mixing._source("source").alias("__src")).withColumn("order", mixing._order("block")).collect()}
    want = {}
    for s in total:
        mine = sorted((p[1:], i) for i, p in places.items() if p[0] == s)
        extra = math.floor((((total[s] / top) ** (a - 1)) - 1) * total[s] + 1e-6)
        used = 0
        for _, i in mine:
            used += tokens[i]
            want[i] = 2 if used <= extra else 1
    got = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    differ = [i for i in want if want[i] != got[i]]
    assert len(got) == 3000 and sum(got.values()) > 3050
    assert len(differ) <= len(total)  # the document at which a budget ends, by rounding of the exponent
