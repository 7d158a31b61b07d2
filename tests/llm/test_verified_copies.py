"""Near duplicates of the pipeline against exact similarities of all pairs."""

import random

import pytest
from plumbline.llm import neardup, widedup


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def exact_groups(texts):
    """The smallest place that links of 0.8 lead to, and the pairs that have one."""
    sets = [shingles(t) for t in texts]
    root, pairs = list(range(len(texts))), []
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                pairs.append((a, b))
    while True:
        was = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == was:
            return root, pairs


def edited(base, edits, rng):
    """``base`` with as many words replaced, each far from the others: five shingles go for each."""
    words = list(base)
    for i in rng.sample(range(0, len(words) // 6), edits):
        words[6 * i + 3] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_links_are_exact(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(50):
        base = rng.choices([f"w{i}" for i in range(5000)], k=240)
        # Similarities with the base from 1 to about 0.55: on both sides of 0.8.
        texts += [" ".join(base), *(edited(base, n, rng) for n in (1, 4, 5, 6, 7, 9, 12))]
    wanted, pairs = exact_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in widedup.similar_documents(docs).collect()}
    assert all(wanted[i] == wanted[c] for i, c in got.items())  # nothing below 0.8 is linked
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert len({*wanted}) > 150  # the variants on the far side stay


@pytest.mark.parametrize("shingles_in_block", [1 << 21, 3000])
def test_groups_in_blocks(spark, monkeypatch, shingles_in_block):
    """A group of over a hundred texts, each like the next one only, in one block and in many."""
    monkeypatch.setattr(widedup, "BLOCK_SHINGLES", shingles_in_block)
    rng = random.Random(12)
    chain, words = [], rng.choices([f"w{i}" for i in range(5000)], k=200)
    for i in range(120):
        words = list(words)
        words[(7 * i) % 200] = f"x{i}"
        chain.append(" ".join(words))
    wanted, _ = exact_groups(chain)
    assert set(wanted) == {0}
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r.component_id for r in widedup.similar_documents(docs).collect()} == {0}
    assert [r.doc_id for r in neardup.first_of_each(docs, prints_of=widedup.fingerprints, groups_of=widedup.groups).collect()] == [0]


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " end"
    rows = [(None, text, 1), (None, near, 2), (4, near, 3), (4, text, 4), (4, text, 4), (7, None, 5), (6, "", 6), (None, None, 7), (8, "it", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = widedup.similar_documents(docs.select("doc_id", "text")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {4, 6, 8}
    kept = neardup.first_of_each(docs, prints_of=widedup.fingerprints, groups_of=widedup.groups)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 6, 8}
    empty = docs.where("false")
    assert widedup.similar_documents(empty).count() == 0
    assert neardup.first_of_each(empty, prints_of=widedup.fingerprints, groups_of=widedup.groups).count() == 0
