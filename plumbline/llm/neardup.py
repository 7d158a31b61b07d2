"""SimHash near-duplicate groups, found by pigeonring filtering.

A 64-bit fingerprint is cut into nine segments on a ring.  If two fingerprints
differ in at most four bits, some segment starts a chain all of whose prefixes
stay within their share of the budget: a chain of l segments differs in at most
4 * l / 9 bits.  So its first two segments agree, and at most one of the first
four and two of the first six differ.  Each fingerprint is filed under the
agreeing segments of every such chain of six (45 keys of 28 or 29 bits);
fingerprints that meet under a key go through the budgets of the longer chains
and last through the full Hamming check.

Equal fingerprints are one node from the start.  Under a key no list of pairs
is written: a task returns each member with the smallest one it is linked to,
which keeps the components whole.  A key with very many fingerprints is cut
into blocks, and every two blocks meet in a task of their own.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.runtime import per_text, scratch, slices, written

MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
SEGMENTS = 2 * MAX_BITS + 1
CHAIN = 6
#: More fingerprints than this under one key are compared block by block.
BLOCK = 1 << 17


def fingerprint(data: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text as a signed 64-bit integer; 0 if it has no word.

    Only A-Z are lower-cased and only ASCII white space parts words, which is
    what ``bytes`` does.
    """
    words = data.lower().split() if data else []
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[start : start + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (signed 64-bit) of every row; a null text counts as empty."""
    return per_text(docs, id_col, text_col, lambda x: (fingerprint(x),), "fp long")


def _segment_masks() -> list[int]:
    edges = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def _budget(length: int) -> int:
    return MAX_BITS * length // SEGMENTS


def _patterns() -> list[tuple[int, list[tuple[int, int]]]]:
    """(mask of the agreeing segments, (mask, budget) of each chain to check) by key kind.

    A kind is a chain's start and the two of its first six segments that may
    differ, at the latest places that the budgets allow for.
    """
    masks, kinds = _segment_masks(), []
    for start in range(SEGMENTS):
        ring = [masks[(start + i) % SEGMENTS] for i in range(SEGMENTS)]
        chains = [(sum(ring[:n]), _budget(n)) for n in range(3, SEGMENTS + 1) if n == SEGMENTS or _budget(n) < _budget(n + 1)]
        for x in range(2, CHAIN):
            for y in range(max(x + 1, 4), CHAIN):
                kinds.append((sum(m for i, m in enumerate(ring[:CHAIN]) if i not in (x, y)), chains))
    return kinds


KINDS = _patterns()
_CHECKS = np.array([[m for m, _ in chains] for _, chains in KINDS], np.uint64)
_BUDGETS = [b for _, b in KINDS[0][1]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_keys(fps: DataFrame) -> DataFrame:
    """``key`` and ``fp``: each fingerprint under every kind of key; the low six bits are the kind."""
    keys = F.array(*(F.xxhash64(F.col("fp").bitwiseAND(F.lit(_signed(m)))).bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(k)) for k, (m, _) in enumerate(KINDS)))
    return fps.select("fp", F.explode(keys).alias("key"))


def _linked(a: np.ndarray, b, kind) -> np.ndarray:
    """Which of ``a`` and ``b`` are within the budgets of the chains, then of all bits."""
    x = a ^ b
    ok = np.ones(len(x), bool)
    for i, most in enumerate(_BUDGETS):
        ok &= np.bitwise_count(x & _CHECKS[kind, i]) <= most
    return ok


def _stars(fps: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and the smallest member of their component, for the fingerprints under one key.

    The seed is the smallest of what is left, and each step drops what it reaches.
    """
    left, members, roots = np.unique(fps), [_NONE], [_NONE]
    while len(left) > 1:
        seed, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = _linked(left, front.pop(), kind)
            if near.any():
                hit, left = left[near], left[~near]
                front.extend(hit)
                members.append(hit)
                roots.append(np.full(len(hit), seed))
    return np.concatenate(members), np.concatenate(roots)


_NONE = np.empty(0, np.uint64)
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _stars_by_key(batches):
    """From rows (fp, key, pair) sorted by key and pair: (member, root) under each of them."""

    def runs(fps, keys, starts, ends):
        out = [(_NONE, _NONE)]
        size = ends - starts
        two = starts[size == 2]
        a, b = fps[two], fps[two + 1]
        ok = _linked(a, b, keys[two] & 63) & (a != b)
        out.append((np.maximum(a, b)[ok], np.minimum(a, b)[ok]))
        out += [_stars(fps[s:e], keys[s] & 63) for s, e in zip(starts[size > 2], ends[size > 2])]
        u, v = (np.concatenate(x) for x in zip(*out))
        if len(u):
            u, v = np.unique(np.stack([u, v]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=_EDGES)

    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the run that may go on in the next batch
    for batch in batches:
        fps, keys, pairs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fps = fps.view(np.uint64)
        if not len(keys):
            continue
        if kept and (kept[0][1][0], kept[0][2][0]) == (keys[-1], pairs[-1]):
            kept.append((fps, keys, pairs))
            continue
        fps, keys, pairs = (np.concatenate(x) for x in zip(*kept, (fps, keys, pairs)))
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (pairs[1:] != pairs[:-1])])
        last = starts[-1]
        yield runs(fps, keys, starts[:-1], starts[1:])
        kept = [(fps[last:], keys[last:], pairs[last:])]
    if kept:
        fps, keys, pairs = (np.concatenate(x) for x in zip(*kept))
        yield runs(fps, keys, np.array([0]), np.array([len(fps)]))


def in_blocks(keys: DataFrame, keys_of, nodes: DataFrame, words: list[str]) -> DataFrame:
    """``keys`` with ``pair``; rows of a key with over ``BLOCK`` fingerprints go to every pair of its blocks.

    One fingerprint in 64 tells which keys are so large; that only shapes tasks.
    ``words`` are the columns of a fingerprint and ``keys_of`` gives the keys of some.
    """
    sample = keys_of(nodes.where(F.xxhash64(*words).bitwiseAND(F.lit(63)) == 0))
    large = sample.groupBy("key").count().where(F.col("count") * 128 >= BLOCK)
    large = written(large.select("key", F.ceil(F.col("count") * 128 / BLOCK).cast("int").alias("blocks")), "large-keys")
    if large.isEmpty():
        return keys.withColumn("pair", F.lit(0))
    mine = F.pmod(F.xxhash64(*words, F.lit(1)), F.col("n")).cast("int")
    others = F.sequence(F.lit(0), F.col("n") - 1)
    pairs = F.transform(others, lambda x: F.least(x, F.col("mine")) * F.col("n") + F.greatest(x, F.col("mine")))
    joined = keys.join(large, "key", "left").withColumn("n", F.coalesce("blocks", F.lit(1))).withColumn("mine", mine)
    return joined.select(*words, "key", F.explode(pairs).alias("pair"))


def stars(links: DataFrame) -> DataFrame:
    """Different links ``u``, ``v`` that keep whole what ``links`` of members ``u`` to roots ``v`` join.

    A member has a root under each of its keys.  It keeps the smallest, which its
    other roots are linked to instead; members of a group share most roots, so
    about one link is left for each member.  A member's list has one root for each
    key and block at most, whatever its group's size; roots get no lists.
    """
    met = links.groupBy("u").agg(F.collect_set("v").alias("roots")).withColumn("least", F.array_min("roots"))
    ends = F.transform("roots", lambda r: F.struct(F.when(r == F.col("least"), F.col("u")).otherwise(r).alias("u"), F.col("least").alias("v")))
    return met.select(F.explode(ends).alias("link")).select("link.*").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` between different fingerprints that keep the components whole."""
    keys = in_blocks(ring_keys(fps), ring_keys, fps, ["fp"])
    dealt = keys.repartition("key", "pair").sortWithinPartitions("key", "pair").select("fp", "key", "pair")
    return stars(dealt.mapInArrow(_stars_by_key, "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest of its component) of each node with an edge.

    Large-star and small-star steps in turn until the edges stay as they are.
    Each step is written into the shared folder.
    """
    lower, upper = F.least("u", "v"), F.greatest("u", "v")
    edges = written(edges.where("u != v").select(upper.alias("u"), lower.alias("v")).distinct(), "edges")
    was = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now


def groups(prints: DataFrame, id_col: str, *_) -> DataFrame:
    """``fp`` and ``component_id`` (the smallest id of its component) of each fingerprint in ``prints``.

    Null ids count only where a component has no other; then it is null.  The
    texts themselves, which other kinds of groups look at, play no part.
    """
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("low")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    A null, empty or wordless text has fingerprint zero and is grouped like any
    other.  Repeated rows stay rows of one group.  An empty table gives none.
    Columns of ``docs`` besides the two are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(groups(prints, id_col), "fp").select(id_col, shown, "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints_of=fingerprints, groups_of=groups) -> DataFrame:
    """The row with the smallest id of each near-duplicate group, with all its columns.

    ``prints_of`` and ``groups_of`` (of fingerprints, id, ``docs`` and text) say
    what a group is.  Of rows that share id
    and fingerprint one stays, that with the smallest text and then the smallest
    JSON; rows that share an id but not the group are told apart by their
    fingerprints.  A group without any id keeps one row.  An empty table gives
    none.
    """
    prints = written(prints_of(docs, id_col, text_col), "fingerprints")
    wins = prints.join(groups_of(prints, id_col, docs, text_col), "fp").where(F.col(id_col).eqNullSafe(F.col("component_id")))
    wins = written(wins.groupBy(id_col, "fp").count(), "first")
    ids = prints.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("rows"))
    again = written(ids.where("rows > 1 or id is null").select("id"), "repeated-ids")
    whole = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"))  # no column of docs can clash
    named = wins.select(F.col(id_col).alias("id")).join(again, "id", "left_anti")
    out = whole.join(named.hint("merge"), "id", "left_semi").select("doc.*")  # ids of most rows: never for a broadcast
    if again.isEmpty():
        return out
    same = F.col("id").eqNullSafe(F.col("again"))
    rest = whole.join(again.withColumnRenamed("id", "again"), same, "left_semi")
    told = prints_of(rest.select(F.struct("id", "doc").alias("k"), F.col("doc")[text_col].alias("text")), "k", "text").select("k.*", "fp")
    first = told.groupBy("id", "fp").agg(F.min_by("doc", F.struct(F.col("doc")[text_col], F.to_json("doc"))).alias("doc"))
    known = wins.select(F.col(id_col).alias("win"), F.col("fp").alias("win_fp"))
    chosen = first.join(known, F.col("id").eqNullSafe(F.col("win")) & (F.col("fp") == F.col("win_fp")), "left_semi")
    return out.unionByName(chosen.select("doc.*"))
