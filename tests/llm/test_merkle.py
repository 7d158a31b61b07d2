"""Manifests against a plain tree, in groups of all sizes, and what changes show."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string, node string, place int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    row = row[:3] + (row[3] + more if row[3] is not None else None,) + row[4:5]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def ascend(nodes, fan):
    """All levels of a list of nodes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def steps(tree, i, fan):
    for nodes in tree[:-1]:
        a = i // fan * fan
        yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + fan])
        i //= fan


def plain(rows, fan, tampered):
    first = lambda v: (v is not None, v or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (first(r[0]), leaf(r)))
        trees[g] = ascend([leaf(r) for r in groups[g]], fan)
    upper = ascend([trees[g][-1][0] for g in names], fan) if names else [[None]]
    for n, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            way = [*steps(trees[g], i, fan), *steps(upper, n, fan)]
            at = leaf(r, tampered(r[0]))
            for a, b in way:
                at = h(a, at, b)
            yield r[0], leaf(r), trees[g][-1][0], upper[-1][0], h(*(a + b for a, b in way)), at, at == upper[-1][0]


@pytest.mark.parametrize(("fan", "depth"), [(2, 2), (3, 1), (2, 10)])
def test_equals_a_plain_tree(spark, fan, depth):
    rng = random.Random(fan)
    sizes = {None: 1, "a": 61, "b": 2, "c": 9, "é": 4, "z": 8, "": 3}
    rows = [(rng.choice([None, rng.randrange(99)]), rng.choice(["s", None]), g, rng.choice([None, 7]), rng.choice(["", "täxt", None]), "x", 1) for g, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, KIND).repartition(4)
    odd = F.col("doc_id") % 2 == 1
    got = merkle.manifest(docs, fan_out=fan, depth=depth, tamper={"n_chars": F.when(odd, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}).collect()
    assert got[0].__fields__ == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain(rows, fan, lambda k: int(k is not None and k % 2 == 1))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "s", "en", 2, "ab", None, None)], KIND)
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == h()
    assert merkle.manifest(docs.where("false")).count() == 0


def test_changed_blocks(spark):
    def tree(changed):
        docs = spark.range(70).select(F.col("id").alias("place"), F.lit("g").alias("group"), F.lit(70).alias("total"), F.sha2(F.when(F.col("id") == changed, "x").otherwise(F.col("id").cast("string")), 256).alias("node"))
        return merkle.block_roots(merkle.grown(docs, "group", depth=3), "group")

    assert [tuple(r) for r in merkle.changed_blocks(tree(-1), tree(42), "group").collect()] == [("g", 5)]
    assert tree(-1).where("tier = 2").count() == 1 and merkle.changed_blocks(tree(3), tree(3), "group").isEmpty()
    assert merkle.changed_blocks(tree(-1).where("block < 8"), tree(-1), "group").count() == 1
