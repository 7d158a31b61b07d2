"""Digests of tables of any size, and what differs between two of them by reading digests first.

In order: rows are cut into blocks by their place, each block is hashed on its
own, and blocks are hashed again until one is left.  Without order: rows are
dealt to buckets by their key, and a bucket's digest is the sum of its rows'
hashes, which no order or layout of files changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.places import bounded
from plumbline.sources.scratch import written

BLOCK, BUCKETS = 1024, 4096


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's columns, by name; null differs from every text."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def block_digests(df: DataFrame, ordinal: str, columns: list[str], size: int = BLOCK) -> DataFrame:
    """``block``, ``n`` and ``digest`` of each ``size`` consecutive rows by their place ``ordinal``, from 0 without gaps."""
    rows = df.select(F.col(ordinal).alias("o"), row_hash(columns).alias("h"))
    return _blocks(rows, size)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    each = F.sort_array(F.collect_list(F.struct("o", "h")))
    told = rows.groupBy(F.floor(F.col("o") / size).alias("block")).agg(each.alias("x"))
    return told.select("block", F.size("x").cast("long").alias("n"), F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256).alias("digest"))


def ordered_digest(df: DataFrame, ordinal: str, columns: list[str], size: int = BLOCK) -> str:
    """One digest of all rows in order; that of an empty table is empty.  Each round has a ``size``-th of the rows of the one before."""
    blocks = written(block_digests(df, ordinal, columns, size), "digests")
    while blocks.limit(2).count() > 1:
        blocks = written(_blocks(blocks.select(F.col("block").alias("o"), F.col("digest").alias("h")), size), "digests")
    top = blocks.first()
    return top.digest if top else ""


def prefix_blocks(rows: DataFrame, results: DataFrame, ordinal: str, columns: list[str], size: int = BLOCK) -> DataFrame:
    """Blocks of ``results`` that are not, row by row, the same in ``rows``; the last block counts only as far as the results go.

    Only the digests are joined; ``rows`` beyond the results are not hashed.
    """
    end = results.agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("end"))  # one row
    rows = rows.crossJoin(F.broadcast(end)).where(F.col(ordinal) <= F.col("end"))
    a, b = block_digests(results, ordinal, columns, size), block_digests(rows, ordinal, columns, size)
    b = b.select(F.col("block").alias("b"), F.col("digest").alias("want"))
    return a.join(b, F.col("block") == F.col("b"), "left").where(~F.col("digest").eqNullSafe(F.col("want"))).select("block")


def bucket_digests(df: DataFrame, key: list[str], columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``n`` and ``digest`` of the rows that their ``key`` deals to each bucket."""
    # two sums of 60 bits of a strong hash, so that rows cannot make up for each other by chance
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")
    rows = df.select(bucket_of(key, buckets).alias("bucket"), row_hash([*key, *columns]).alias("h"))
    told = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))
    return told.select("bucket", "n", F.concat_ws(":", "n", "a", "b").alias("digest"))


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(c) for c in key)), F.lit(buckets)).cast("int")


def changes(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """How two tables differ: the ``key``, ``change`` (missing, added, doubled, changed) and the counts ``n_old`` and ``n_new``.

    Digests of both are compared first; of tables that are equal no row is read
    again, else only rows of buckets that differ are.  Rows of a key are
    compared as a multiset: it is ``doubled`` if just their number differs.
    """
    a = bucket_digests(old, key, columns, buckets).select("bucket", F.col("digest").alias("a"))
    b = bucket_digests(new, key, columns, buckets).select("bucket", F.col("digest").alias("b"))
    wrong = written(a.join(b, "bucket", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket"), "buckets")
    return row_changes(*(df.withColumn("__bucket", bucket_of(key, buckets)).join(bounded(wrong), F.col("__bucket") == F.col("bucket"), "left_semi") for df in (old, new)), key, columns)


def row_changes(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    side = lambda df, o, n: df.select(*key, row_hash([*key, *columns]).alias("h"), F.lit(o).alias("o"), F.lit(n).alias("n"))
    # a row for each key and content, with how often each side has it: a key with many rows is summed before they meet
    each = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(*key, "h").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    told = each.groupBy(*key).agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new"), F.max(F.col("o") != F.col("n")).alias("differs"), F.max((F.col("o") == 0) | (F.col("n") == 0)).alias("other"))
    change = F.when(F.col("n_new") == 0, "missing").when(F.col("n_old") == 0, "added").when(F.col("other"), "changed").otherwise("doubled")
    return told.where("differs").select(*key, change.alias("change"), "n_old", "n_new")
