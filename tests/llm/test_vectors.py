"""Product codes against k-means by all distances, with integers of any size."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import queries, vectors

KIND = "vec_id long, embedding array<double>, label int, code string, ints int"


def plain(rows, parts, entries, rounds):
    """Every distance of every part in Python's integers."""
    kept = [(k, [math.floor(1024 * x) for x in v], g) for k, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    d = len(kept[0][1]) // parts
    cut = [[v[i * d : i * d + d] for i in range(parts)] for _, v, _ in kept]
    books = [[c[i] for c in cut[:entries]] for i in range(parts)]

    def near(i, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[i]))

    for _ in range(rounds):
        for i in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[near(i, c[i])[1]].append(c[i])
            books[i] = [[sum(x) // len(mine[j]) for x in zip(*mine[j])] if j in mine else e for j, e in enumerate(books[i])]
    found = [[near(i, c[i]) for i in range(parts)] for c in cut]
    sums = defaultdict(int)
    for (_, _, g), f in zip(kept, found):
        sums[g] += sum(e for e, _ in f)
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    fits = lambda n: n if n < 1 << 63 else None
    return [(k, "".join(f"{j:02x}" for _, j in f), fits(sum(e for e, _ in f)), fits(sums[g]), sha) for (k, _, g), f in zip(kept, found)]


def compressed(spark, rows, *sizes):
    df = spark.createDataFrame([(k, v, g, "x", 1) for k, v, g in rows], KIND).repartition(3)
    return [tuple(r) for r in vectors.compress(df, "vec_id", "embedding", "label", *sizes).collect()]


@pytest.mark.parametrize("spread", [0.02, 1.0, 3e9, 1e200])
def test_equals_all_distances(spark, spread):
    rng = random.Random(spread)
    rows = [(i, [rng.choice([-1, 1, 2]) * spread + rng.gauss(0, spread / 9) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(120)]
    rows += [(500 + i, rows[i][1], 3) for i in range(20)]  # repeats, so entries tie
    rows += [(-1, None, 1), (-2, [None] * 8, 1), (-3, [float("nan")] * 8, 1), (-4, [1.0] * 7 + [float("inf")], None)]
    rng.shuffle(rows)
    assert sorted(compressed(spark, rows, 4, 16, 3), key=str) == sorted(plain(rows, 4, 16, 3), key=str)


def test_null_ids_few_rows_and_none(spark):
    rows = [(None, [1.0, 2.0], None), (7, [0.5, 0.25], 1), (7, [0.5, 0.25], 1)]
    assert sorted(compressed(spark, rows, 2, 256, 4), key=str) == sorted(plain(rows, 2, 256, 4), key=str)
    assert compressed(spark, [(1, None, 1)], 4, 256, 4) == []
    with pytest.raises(ValueError, match="one length"):
        compressed(spark, [(1, [1.0, 2.0, 3.0], 1)], 2, 256, 4)


def test_the_search_skips_what_is_too_far():
    rng = np.random.default_rng(3)
    centres = rng.integers(-9000, 9000, (64, 4))
    search = vectors.Search(centres)
    x = np.repeat(centres, 50, 0) + rng.integers(-60, 60, (3200, 4))
    before = np.repeat(np.arange(64), 50)
    before[::7] = 5
    at, d = search(x, before)
    every = ((x[:, None] - centres) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all() and search.scanned < every.size / 2


def test_the_table_equals_all_distances(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    x = duckdb.sql(f"select vec_id, embedding, label from '{sf}/embeddings.parquet' order by vec_id").fetchall()
    got = sorted(tuple(r) for r in queries.op11_vector_codes(spark, sf).collect())
    ints = np.array([np.floor(np.array(v) * 1024) for _, v, _ in x]).astype(np.int64)
    books = [ints[:256, 16 * i : 16 * i + 16] for i in range(4)]
    every = lambda i: ((ints[:, None, 16 * i : 16 * i + 16] - books[i]) ** 2).sum(2)
    for _ in range(4):
        at = [every(i).argmin(1) for i in range(4)]
        books = [np.array([ints[at[i] == j, 16 * i : 16 * i + 16].sum(0) // max(1, (at[i] == j).sum()) if (at[i] == j).any() else books[i][j] for j in range(256)]) for i in range(4)]
    last = [every(i) for i in range(4)]
    codes = np.stack([e.argmin(1) for e in last], 1)
    errors = sum(e.min(1) for e in last)
    assert [r[:3] for r in got] == [(k, "".join(f"{j:02x}" for j in c), e) for (k, _, _), c, e in zip(x, codes.tolist(), errors.tolist())]
    labels = defaultdict(int)
    for (_, _, g), e in zip(x, errors.tolist()):
        labels[g] += e
    assert [r[3] for r in got] == [labels[g] for _, _, g in x] and {r[4] for r in got} == {vectors.digest_of(books)}
