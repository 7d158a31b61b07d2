"""Large groups of near copies: links grow with the members, not with the keys that they share."""

import random

from plumbline.llm import neardup, widedup


def near_copies(n):
    """Texts of 120 words, one to three of them replaced, each far from the others."""
    rng = random.Random(5)
    base = rng.choices([f"w{i}" for i in range(5000)], k=120)
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(20), 1 + i % 3):
            words[6 * k + 3] = f"x{rng.randrange(10**9)}"
        yield i, " ".join(words)


def test_candidates_of_a_group_have_about_a_link_each(spark, monkeypatch):
    counts, components = [], widedup.components

    def counted(edges):
        counts.append(edges.count())
        return components(edges)

    monkeypatch.setattr(widedup, "components", counted)
    for n in (200, 600):
        docs = spark.createDataFrame(list(near_copies(n)), "doc_id long, text string")
        widedup.similar_documents(docs).count()
        assert counts[-2] < 3 * n and counts[-1] < n


def test_fingerprints_of_a_group_have_about_a_link_each(spark):
    rng = random.Random(6)
    fps = sorted({sum(1 << p for p in rng.sample(range(63), 2)) for _ in range(500)})
    edges = neardup.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert edges.count() < 3 * len(fps)
    roots = {r.node: r.root for r in neardup.components(edges).collect()}
    assert {fps[0], *roots} == set(fps) and set(roots.values()) == {fps[0]}


def test_stars_join_what_the_links_join(spark):
    rng = random.Random(7)
    links = [(u, rng.choice(roots)) for roots in ([1, 2, 3, 4], [-5, -6, 7], [8]) for u in range(10 * roots[0] + 100, 10 * roots[0] + 108) for _ in range(5)]
    links += [(4, 2), (3, 1), (-5, -6)]
    edges = spark.createDataFrame(links, "u long, v long")
    few = neardup.stars(edges)
    assert few.count() <= len({x for e in links for x in e}) + 6
    assert sorted(neardup.components(few).collect()) == sorted(neardup.components(edges).collect())
