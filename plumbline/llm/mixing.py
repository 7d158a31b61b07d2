"""Mixing sources by temperature.

Texts are encoded to count their tokens.  A source with a share p of all tokens
gets a weight in proportion to p ** a.  The exponent a is bisected to the
largest flattening within a limit on how often a document repeats, or to a
target entropy of the weights.  The weights become
copies: a source's documents lie in blocks, the blocks in a random but fixed
order; every document gets the whole number of copies that all get, and the
documents of the first blocks, as many as the budget has tokens for, get one
more.  Within the block where the budget ends documents go by the order of a
hash.  Rows decide on their own from one row for each source; nothing is sorted
but the documents of one block for each source.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.runtime import per_slice, written
from plumbline.llm.tokenout import encoder, shared_ranks

#: Blocks of each source.
BLOCKS = 1 << 12
SEED = 8
BISECTIONS = 40


def token_rows(docs: DataFrame, tokenizer_path: str, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``source_col`` and ``n_tokens`` of every row, its whole text encoded by a tokenizer file.

    A null or empty text has no tokens; nulls in the other columns and rows that
    repeat stay.  The rows are written: texts are encoded once, however often
    the counts are read.
    """
    ranks = shared_ranks(docs.sparkSession, tokenizer_path)

    def kernel(texts: pa.Array):
        _, ends = encoder(tokenizer_path, ranks.value)(pc.fill_null(texts, "").to_pylist())
        return (np.diff(ends, prepend=0),)

    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source")).alias("key"), F.col(text_col).alias("text"))
    counted = per_slice(rows, "key", "text", kernel, "n_tokens long")
    return written(counted.select(F.col("key.id").alias(id_col), F.col("key.source").alias(source_col), "n_tokens"), "token-rows")


def _tokens(col: str) -> Column:
    """A null count is none."""
    return F.coalesce(F.col(col).cast("long"), F.lit(0).cast("long"))


def _source(col: str):
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


def bisect_exponent(sources: DataFrame, max_repetition: float | None = None, entropy: float | None = None) -> float:
    """The exponent in [0, 1] for ``sources`` (``source``, ``tokens``).

    ``max_repetition``: the smallest exponent at which no source is repeated more
    than that often, where the largest source is taken once.  ``entropy``: that
    at which the weights have this entropy in nats (0 or 1 if out of reach).
    Either needs only sums over the sources, so their number does not matter.
    """
    some = sources.where("tokens > 0")
    total = some.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("hi"), F.min("tokens").alias("lo")).first()
    if total["t"] is None:
        return 1.0

    def too_flat(exponent: float) -> bool:
        if max_repetition is not None:
            return (total["lo"] / total["hi"]) ** (exponent - 1) > max_repetition
        p = F.pow(F.col("tokens") / F.lit(float(total["t"])), F.lit(exponent))
        z = some.agg(F.sum(p).alias("z"), F.sum(p * F.log(p)).alias("pl")).first()
        return math.log(z["z"]) - z["pl"] / z["z"] > entropy

    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(BISECTIONS if max_repetition is not None else 20):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def plan(counts: DataFrame, max_repetition: float | None = 1.25, entropy: float | None = None, budget_tokens: int | None = None, source_col: str = "source", tokens_col: str = "n_tokens", id_col: str = "doc_id") -> DataFrame:
    """One row for each source: ``weight``, ``budget`` in tokens, whole ``copies`` and where the extra copies end.

    ``counts`` has one row for each document, as from ``token_rows``.  Without ``budget_tokens`` the budget is the least at which no document is
    left out: the source with the highest share against its weight is taken once.
    """
    block, rank = _places(id_col)
    rows = counts.select(_source(source_col).alias("__src"), _tokens(tokens_col).alias("tokens"), block.alias("block"), rank.alias("rank"))
    blocks = written(rows.groupBy("__src", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "blocks")
    sources = blocks.groupBy("__src").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
    exponent = bisect_exponent(sources, max_repetition, entropy)
    sums = sources.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(exponent))).alias("z"), F.max("tokens").alias("hi")).first()
    z = sums["z"] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    budget = budget_tokens if budget_tokens is not None else (sums["hi"] or 1) / ((sums["hi"] or 1) ** exponent / z)
    times = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(float(budget)) / F.col("tokens")).otherwise(F.lit(1.0))
    sources = sources.withColumn("weight", weight).withColumn("times", times)
    whole = F.floor(F.col("times") + F.lit(1e-9))
    sources = sources.withColumn("copies", whole.cast("int")).withColumn("extra", F.floor((F.greatest(F.col("times") - whole, F.lit(0.0))) * F.col("tokens") + F.lit(1e-6)).cast("long"))
    order = Window.partitionBy("__src").orderBy(_order("block"), "block")
    filled = blocks.withColumn("before", F.sum("tokens").over(order) - F.col("tokens")).join(sources.select("__src", "extra"), "__src")
    last = filled.where("before < extra and before + tokens >= extra").groupBy("__src").agg(F.min(F.struct("before", "block")).alias("s")).select("__src", F.col("s.before").alias("before"), F.col("s.block").alias("last_block"))
    last = written(last, "last-blocks")
    within = Window.partitionBy("__src").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    inside = rows.join(last, "__src").where("block = last_block").withColumn("upto", F.col("before") + F.sum("tokens").over(within)).join(sources.select("__src", "extra"), "__src")
    cut = inside.where("upto <= extra").groupBy("__src").agg(F.max("rank").alias("last_rank"))
    return sources.join(last.drop("before"), "__src", "left").join(cut, "__src", "left").select("__src", "tokens", "docs", "weight", (F.col("weight") * F.lit(float(budget))).alias("budget"), "copies", "extra", "last_block", "last_rank", F.lit(exponent).alias("exponent"))


def _places(id_col: str):
    """A document's block, and its rank within the block."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(BLOCKS)).cast("int"), F.xxhash64(F.col(id_col), F.lit(SEED + 1))


def _order(block: str):
    """Where a block stands among those of its source."""
    return F.xxhash64(F.col("__src"), F.col(block), F.lit(SEED + 2))


def mix(docs: DataFrame, counts: DataFrame | None = None, max_repetition: float | None = 1.25, entropy: float | None = None, budget_tokens: int | None = None, source_col: str = "source", tokens_col: str = "n_tokens", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as its source's weight and its place say.

    ``counts`` (``token_rows`` of ``docs``) has the tokens, and rows keep just
    their columns.  Without it ``docs`` has them itself in ``tokens_col``, and
    rows also get ``copy`` (from 1) and ``block``, in place of columns of these
    names.  A null source is one of its own.  A source without tokens is taken
    once.  Rows that share an id share a place, so they are taken equally often;
    a budget that ends among them leaves them all at the lower number.  An empty
    table gives none.
    """
    sources = written(plan(docs if counts is None else counts, max_repetition, entropy, budget_tokens, source_col, tokens_col, id_col), "mixing-plan")
    block, rank = _places(id_col)
    rows = docs.select(F.struct("*").alias("doc"), _source(source_col).alias("__src"), block.alias("place"), rank.alias("rank"))
    ends = sources.select("__src", "copies", "last_block", F.coalesce("last_rank", F.lit(-(1 << 63))).alias("most"), F.col("last_rank").isNotNull().alias("cuts"), _order("last_block").alias("last_order"))
    extra = F.col("last_block").isNotNull() & ((_order("place") < F.col("last_order")) | ((F.col("place") == F.col("last_block")) & (F.col("rank") <= F.col("most")) & F.col("cuts")))
    rows = rows.join(ends, "__src").withColumn("n", F.col("copies") + extra.cast("int")).where("n > 0")
    rows = rows.select("doc", "place", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    if counts is not None:
        return rows.select("doc.*")
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ("copy", "block")]
    return rows.select(*kept, "copy", F.col("place").alias("block"))
