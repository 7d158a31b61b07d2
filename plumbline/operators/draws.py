"""Draws that equal those of Python's generator, a Mersenne twister, for the same seed.

A generator's numbers follow from each other, so each pool has one of its own and
pools are drawn in parallel.  A sample needs only the number of rows and the
sample's size: which places it takes is drawn, and rows are found by their place.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.places import FEW, null_safe, numbered

#: Draws in one row between the generator and the pool's rows.
CHUNK = 4096


def generator(seed: int, key: str) -> random.Random:
    """The generator of one pool: seeded by the SHA-256 of the seed and the pool's key."""
    return random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest(), "big"))


def _drawn(seed: int):
    def run(batches):
        names = ["__key", "__no", "__draws"]
        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                draw = generator(seed, key).random
                for chunk in range(0, n, CHUNK):
                    values = [draw() for _ in range(min(CHUNK, n - chunk))]
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([chunk // CHUNK]), pa.array([values])], names=names)

    return run


def pool_draws(pool: DataFrame, key: str, place: str, seed: int, score: str = "score") -> DataFrame:
    """``pool`` with ``score``: of each ``key`` (as text) the numbers that its generator gives in the order of ``place``, which counts from 0 without gaps.

    Rows of a null key or place have a null score.  A pool of any size is drawn
    chunk by chunk and joined chunk by chunk.
    """
    sizes = pool.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg((F.max(place) + 1).cast("long").alias("n")).where("n is not null")
    chunks = sizes.mapInArrow(_drawn(seed), "__key string, __no long, __draws array<double>")
    told = pool.withColumn("__chunk", F.floor(F.col(place) / CHUNK))
    rows = told.join(chunks, (told[key].cast("string") == chunks["__key"]) & (told["__chunk"] == chunks["__no"]), "left")
    at = (F.col(place) - F.col("__chunk") * CHUNK + 1).cast("int")
    return rows.withColumn(score, F.try_element_at("__draws", at)).select(*pool.columns, score)


def exact_sample(df: DataFrame, n: int, seed: int, order: list[str]) -> DataFrame:
    """The ``n`` rows that a generator with ``seed`` takes of the rows in ``order``, with ``drawn``: 0 for the first it took.

    Fewer rows than ``n`` raise.  Places are drawn here, ``n`` numbers; rows are
    not moved but to be numbered.
    """
    rows = numbered(df, order, place="__place")
    total = rows.count()
    if n > total:
        raise ValueError(f"{n} rows are asked for and there are {total}")
    taken = [(at, i) for i, at in enumerate(random.Random(seed).sample(range(total), n))]
    places = df.sparkSession.createDataFrame(taken, "__place long, drawn long")
    return null_safe(rows, F.broadcast(places) if n <= FEW else places, ["__place"]).drop("__place")
