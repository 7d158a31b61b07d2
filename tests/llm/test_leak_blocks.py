"""A benchmark in several blocks cuts as one automaton does."""

import pytest

from plumbline.llm import decontam


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 12])  # one automaton, and one for each item
def test_blocks_cut_as_one_automaton(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    a, b, c = words("a", 12), words("b", 12), words("c", 12)
    bench = spark.createDataFrame([(1, a), (2, b), (3, c)], "item_id long, text string").coalesce(1)
    halves = a.replace("a6", f"{b} a6")  # cutting b joins a window of a
    docs = {
        1: f"{words('x', 8)} {a} {b} {words('y', 8)}",  # 12 of 40 words by each: 60 %
        2: f"{words('x', 30)} {a}. {words('y', 30)}",
        3: f"{words('x', 30)} {halves} {words('y', 30)}",
        4: words("x", 30), 5: "", 6: None, 7: a,
    }
    table = spark.createDataFrame([(k, "s", t) for k, t in docs.items()], "doc_id long, source string, text string")
    clean = decontam.remove_leaks(table, bench)
    assert clean.columns == table.columns
    got = {r.doc_id: r.text and " ".join(r.text.split()) for r in clean.collect()}
    x, y = words("x", 30), words("y", 30)
    assert got == {2: f"{x} . {y}", 3: f"{x} {y}", 4: x, 5: "", 6: None}
