"""SimHash near-duplicate groups at a set similarity of word shingles, found by pigeonring filtering, each link checked exactly.

At a Jaccard similarity of 0.8 two SimHash fingerprints differ in about 15 % of
their bits, and no filing covers that many of 256 exactly at a bearable cost.  So
pigeonring filters drawn fingerprints: ``DRAWS`` times ``DRAWN_BITS`` of the 256
bits, cut into three segments on a ring.  If two of them differ in at most
``DRAWN_DIFFER`` bits, some segment starts a chain all of whose prefixes stay
within their share of the budget: one of l segments differs in at most l / 3
bits.  So its first two segments agree, which is the key that a fingerprint is
filed under, one for each draw and start, and exact for the draw.  Fingerprints
that meet under a key go through the budget of the whole chain, then are compared
word by word, and are candidates if all 256 bits differ in ``MAX_BITS`` at most.
A pair at 0.8 is a candidate with a chance of ``RECALL``.

Candidates only say which texts may belong together.  Within each group that
they form, the sets of shingles themselves meet, one set for each fingerprint,
and two texts are linked if they share ``SIMILARITY`` of their shingles.  A group
of more than ``BLOCK_SHINGLES`` is cut into blocks, and every two blocks meet in
a task of their own, which returns links and no list of pairs.
"""

from __future__ import annotations

import math
import random
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.neardup import components, in_blocks, stars
from plumbline.llm.runtime import as_bytes, per_slice, written

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)
SEED = 42
WORDS = 4  # of 64 bits
BITS = 64 * WORDS
#: The share of bits in which two texts at ``SIMILARITY`` are expected to differ.
EXPECTED = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Bits in which candidates differ at most: what is expected and three standard deviations.
MAX_BITS = round(BITS * EXPECTED + 3 * math.sqrt(BITS * EXPECTED * (1 - EXPECTED)))
DRAWN_DIFFER = 1
SEGMENTS = 2 * DRAWN_DIFFER + 1
SEGMENT_BITS = 7  # of the eight of a byte
DRAWN_BITS = SEGMENT_BITS * SEGMENTS
#: Segments of a chain whose share of the budget is none: they agree.
AGREE = 2
RECALL = 0.98
#: Keys with up to so many fingerprints are compared together, pair by pair in memory.
SMALL = 128
#: Rows of such keys, and pairs of rows of a larger one, that are compared in one go, about.
TOGETHER = 1 << 14
PAIRS_TOGETHER = 1 << 20
#: Shingles in a block of a group of candidates, of which a task holds two.
BLOCK_SHINGLES = 1 << 21
#: Bits for each candidate, and in all, of the table that keeps other texts from being shuffled.
MARK_BITS = 16
MOST_MARKS = 1 << 26

_MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(_MIX[1])
    x = (x ^ x >> np.uint64(30)) * np.uint64(_MIX[2])
    x = (x ^ x >> np.uint64(27)) * np.uint64(_MIX[3])
    return x ^ x >> np.uint64(31)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each bit, from the highest."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 255 << 8):
        bits = np.unpackbits(hashes[start : start + (255 << 8)].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        ones += bits[whole:].sum(0, dtype=np.uint8)
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return ones


def shingles(data: bytes | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted hashes of a text's shingles, each once; none if it has no word.

    Only A-Z are lower-cased and only ASCII white space parts words; a text of
    fewer words than a shingle is one shingle.
    """
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def fingerprint(hashes: np.ndarray) -> list[int]:
    """The words of the fingerprint of ``shingles`` as signed integers; zeros if there are none."""
    out = [np.packbits(2 * _ones(_mixed(hashes, salt)) > len(hashes)) for salt in _MIX]
    return np.concatenate(out).view(">i8").tolist()


def node_of(f: np.ndarray) -> np.ndarray:
    """One number for each row of fingerprint words."""
    x = np.zeros(len(f), np.uint64)
    for i in range(WORDS):
        x = _mixed(x ^ f[:, i], _MIX[i])
    return x.view(np.int64)


def _columns(texts: list[bytes | None], shingle_words: int) -> list[np.ndarray]:
    prints, counts = [], []
    for t in texts:
        hashes = shingles(t, shingle_words)
        prints.append(fingerprint(hashes))
        counts.append(len(hashes))
    f = np.array(prints, np.int64).reshape(-1, WORDS)
    digests = np.array([xxhash.xxh64_intdigest(t or b"", SEED) for t in texts], np.uint64).view(np.int64)
    return [*f.T, node_of(f.view(np.uint64)), np.array(counts, np.int64), digests]


F_COLS = [f"f{i}" for i in range(WORDS)]
PRINT = ", ".join(f"{c} long" for c in F_COLS) + ", fp long, shingles long, digest long"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``id_col``, the words ``f0`` to ``f3``, ``fp`` (one number for all of them), the count of ``shingles`` and the ``digest`` (Spark's ``xxhash64``) of every row."""

    return per_slice(docs, id_col, text_col, lambda texts: _columns(as_bytes(texts), shingle_words), PRINT)


def budget(length: int) -> int:
    """Bits in which a chain of so many segments may differ."""
    return DRAWN_DIFFER * length // SEGMENTS


def recall(draws: int) -> float:
    """The chance that a pair at ``SIMILARITY`` differs in ``MAX_BITS`` at most and in ``DRAWN_DIFFER`` of some draw's bits."""
    found = 0.0
    for d in range(MAX_BITS + 1):
        near = sum(math.comb(d, i) * math.comb(BITS - d, DRAWN_BITS - i) for i in range(DRAWN_DIFFER + 1)) / math.comb(BITS, DRAWN_BITS)
        found += math.comb(BITS, d) * EXPECTED**d * (1 - EXPECTED) ** (BITS - d) * (1 - (1 - near) ** draws)
    return found


DRAWS = next(n for n in range(1, 1000) if recall(n) >= RECALL)


def _drawn() -> np.ndarray:
    """The bits of each draw and segment, filled up to a byte by one that no fingerprint has."""
    rng = random.Random(SEED)
    bits = np.array([rng.sample(range(BITS), DRAWN_BITS) for _ in range(DRAWS)]).reshape(DRAWS, SEGMENTS, SEGMENT_BITS)
    return np.pad(bits, ((0, 0), (0, 0), (0, 8 - SEGMENT_BITS)), constant_values=BITS)


_DRAWN = _drawn()


def _bits_at(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of the bits ``at`` (eight to a byte; for all rows, or a row for each) of fingerprint words."""
    rows = np.pad(np.ascontiguousarray(f).view(np.uint8), ((0, 0), (0, 1)))
    bits = (rows[:, at >> 3] if at.ndim == 1 else np.take_along_axis(rows, at >> 3, 1)) >> (at & 7).astype(np.uint8) & 1
    return np.packbits(bits, axis=1)


def _chain_end(f: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The segment that ends the chain of each row's key."""
    draw, start = np.divmod(keys >> 8 * AGREE, SEGMENTS)
    return _bits_at(f, _DRAWN[draw, (start + AGREE) % SEGMENTS])[:, 0]


def _ring_rows(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            f = _words_of(batch.slice(start, 1000))
            parts = _bits_at(f, _DRAWN.reshape(-1)).reshape(len(f), DRAWS, SEGMENTS).astype(np.int64)
            kinds = np.arange(DRAWS * SEGMENTS).reshape(DRAWS, SEGMENTS)
            keys = kinds << 16 | parts << 8 | np.roll(parts, -1, axis=2)
            columns = [*(np.repeat(f[:, i], DRAWS * SEGMENTS).view(np.int64) for i in range(WORDS)), keys.reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*F_COLS, "key"])


def _words_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(WORDS)], axis=1)


def ring_keys(nodes: DataFrame) -> DataFrame:
    """The words and ``key`` of each fingerprint, for every draw and start of a chain: number of both, then the two segments that agree."""
    return nodes.select(*F_COLS).mapInArrow(_ring_rows, ", ".join(f"{c} long" for c in (*F_COLS, "key")))


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` differ in ``MAX_BITS`` at most; each word drops those beyond the budget."""
    left = np.arange(max(len(a), len(b)))
    a, b = np.broadcast_arrays(a, b)
    total = np.zeros(len(left), np.int64)
    for i in range(WORDS):
        total[left] += np.bitwise_count(a[left, i] ^ b[left, i])
        left = left[total[left] <= MAX_BITS]
    out = np.zeros(len(total), bool)
    out[left] = True
    return out


def _near(f: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows ``a`` and ``b`` that share a key are within the whole chain's budget and then ``MAX_BITS``: their places."""
    left = np.flatnonzero(np.bitwise_count(ends[a] ^ ends[b]) <= budget(SEGMENTS))
    return left[_linked(f[a[left]], f[b[left]])]


def _small(f: np.ndarray, ends: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) rows for runs of up to ``SMALL`` rows; ``run`` numbers the runs."""
    a, b = [], []
    for shift in range(1, SMALL):
        i = np.flatnonzero(run[shift:] == run[:-shift])
        if not len(i):
            break
        i = i[_near(f, ends, i, i + shift)]
        a.append(i)
        b.append(i + shift)
    if not a:
        return np.empty(0, int), np.empty(0, int)
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(f))
    while True:  # the smallest row that links lead to
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            break
    member = np.flatnonzero(root != np.arange(len(f)))
    return member, root[member]


def _large(f: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) rows for one run: the seed is the first of what is left that reaches another, each step drops what it reaches."""
    left, members, roots = np.arange(len(f)), [np.empty(0, int)], [np.empty(0, int)]
    some = 1  # rows that look for others at once; most reach none
    while len(left) > 1:
        at, to = np.nonzero(np.bitwise_count(ends[left[:some], None] ^ ends[left]) <= budget(SEGMENTS))
        at, to = at[to > at], to[to > at]
        at = at[_linked(f[left[at]], f[left[to]])]
        if not len(at):
            left, some = left[some:], max(1, min(SMALL, PAIRS_TOGETHER // len(left)))
            continue
        seed, left, some = left[at[0]], left[at[0] + 1 :], 1
        front = [seed]
        while front and len(left):
            near = _near(f, ends, left, np.full(len(left), front.pop()))
            if len(near):
                hit, left = left[near], np.delete(left, near)
                front.extend(hit.tolist())
                members.append(hit)
                roots.append(np.full(len(hit), seed))
    return np.concatenate(members), np.concatenate(roots)


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges_of(f: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    sizes = np.diff(np.r_[starts, len(f)])
    run = np.repeat(np.arange(len(starts)), sizes)
    f = f[np.lexsort((node_of(f), run))]  # under every key the same few nodes of a group are its roots
    ends = _chain_end(f, keys)
    small = (sizes <= SMALL)[run] & (sizes > 1)[run]
    at = np.flatnonzero(small)
    m, r = _small(f[at], ends[at], run[at])
    members, roots = [at[m]], [at[r]]
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        m, r = _large(f[s : s + n], ends[s : s + n])
        members.append(s + m)
        roots.append(s + r)
    node = node_of(f)
    u, v = node[np.concatenate(members)], node[np.concatenate(roots)]
    if len(u):
        u, v = np.unique(np.stack([u, v]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGES)


def _edges_by_key(batches):
    """From rows (words, key, pair) sorted by key and pair: (member, root) under each of them."""
    kept: list[tuple] = []  # rows that wait for more, the last of them a run that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append((_words_of(batch), *(batch.column(WORDS + i).to_numpy() for i in range(2))))
        if sum(len(k) for _, k, _ in kept) < TOGETHER or (kept[0][1][0], kept[0][2][0]) == (kept[-1][1][-1], kept[-1][2][-1]):
            continue
        f, keys, pairs = (np.concatenate(x) for x in zip(*kept))
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (pairs[1:] != pairs[:-1])])
        last = starts[-1]
        yield _edges_of(f[:last], keys[:last], starts[:-1])
        kept = [(f[last:], keys[last:], pairs[last:])]
    if kept:
        f, keys, pairs = (np.concatenate(x) for x in zip(*kept))
        yield _edges_of(f, keys, np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (pairs[1:] != pairs[:-1])]))


def _alike(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of ``others`` share ``SIMILARITY`` of their shingles with ``a``; no set is empty."""
    sizes = np.array([len(x) for x in others])
    fit = np.flatnonzero(np.minimum(sizes, len(a)) * SIMILARITY.denominator >= np.maximum(sizes, len(a)) * SIMILARITY.numerator)
    out = np.zeros(len(others), bool)
    if len(fit):
        sizes, both = sizes[fit], np.concatenate([others[i] for i in fit])
        shared = np.add.reduceat(a[np.minimum(np.searchsorted(a, both), len(a) - 1)] == both, np.cumsum(sizes) - sizes, dtype=np.int64)
        out[fit] = shared * SIMILARITY.denominator >= (sizes + len(a) - shared) * SIMILARITY.numerator
    return out


def _verified(f: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of one block or two; each is a pair of candidates whose sets are alike."""
    left, links = np.arange(len(f)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.flatnonzero(_linked(f[left], f[at][None]))
            near = near[_alike(sets[at], [sets[i] for i in left[near]])] if len(near) else near
            if len(near):
                hit, left = left[near], np.delete(left, near)
                front.extend(hit.tolist())
                links += [(i, at) for i in hit.tolist()]
    return links


def _sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    lists = batch.column(WORDS)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    return [values[i:j] for i, j in zip(offsets, offsets[1:])]


def _links_by_block(batches):
    """From rows (words, set, group, pair) sorted by the last two: verified links under each of them."""

    def links(f, sets):
        f, first = np.unique(f, axis=0, return_index=True)  # repeated rows
        found = _verified(f, [sets[i] for i in first])
        node = node_of(f)
        u, v = (node[[x[i] for x in found]] for i in range(2)) if found else (node[:0], node[:0])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGES)

    f, sets, now = [], [], None  # the rows of the block pair at hand
    for batch in batches:
        if not batch.num_rows:
            continue
        words, lists = _words_of(batch), _sets_of(batch)
        group, pair = (batch.column(WORDS + i).to_numpy() for i in (1, 2))
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (pair[1:] != pair[:-1])])
        for s, e in zip(starts, np.r_[starts[1:], len(group)]):
            if now != (group[s], pair[s]):
                if sets:
                    yield links(np.concatenate(f), sets)
                f, sets, now = [], [], (group[s], pair[s])
            f.append(words[s:e])
            sets += lists[s:e]
    if sets:
        yield links(np.concatenate(f), sets)


def _marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose digest may be one of ``wanted``.

    A set of bits, broadcast 64 to a row: a million rows at most, whatever the
    corpus.  Where candidates outgrow it more rows pass, and the join sorts them out.
    """
    size = min(MOST_MARKS, 1 << max(10, (MARK_BITS * wanted.count() - 1).bit_length()))
    slot = F.pmod("digest", F.lit(size))
    word, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, cast(pmod(digest, {size}) % 64 as int))")
    marks = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return texts.withColumn("word", word).join(F.broadcast(marks), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def verified_links(near: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links ``u``, ``v`` that keep whole what exact similarity joins among the candidates of each ``group``.

    ``near`` has the words, ``fp``, ``shingles``, ``group`` of each fingerprint, and id and digest of a text that has it.
    """
    sizes = near.where("shingles > 0").groupBy("group").agg(F.count("*").alias("members"), F.sum("shingles").alias("total"))
    sizes = sizes.where("members > 1").select("group", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("n"))
    wanted = near.where("shingles > 0").join(sizes, "group").select("low", "digest", F.struct(*F_COLS, "fp", "group", "n").alias("k"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = written(wanted, "candidates")
    texts = _marked(texts.withColumn("digest", F.xxhash64("text")), wanted)
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("low")) & (texts["digest"] == wanted["digest"]))
    sets = per_slice(texts, "k", "text", lambda t: ([shingles(x).view(np.int64) for x in as_bytes(t)],), "found array<long>").select("k.*", "found")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")).cast("int")
    others = F.sequence(F.lit(0), F.col("n") - 1)
    pairs = F.transform(others, lambda x: F.least(x, F.col("mine")) * F.col("n") + F.greatest(x, F.col("mine")))
    dealt = sets.withColumn("mine", mine).select(*F_COLS, "found", "group", F.explode(pairs).alias("pair"))
    dealt = dealt.repartition("group", "pair").sortWithinPartitions("group", "pair")
    return stars(dealt.mapInArrow(_links_by_block, "u long, v long"))


def groups(prints: DataFrame, id_col: str, docs: DataFrame, text_col: str) -> DataFrame:
    """``fp`` and ``component_id`` (the smallest id of its component; null if it has none) of each fingerprint of ``docs``."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("low"), "digest")).alias("first")
    nodes = prints.groupBy("fp", *F_COLS).agg(F.max("shingles").alias("shingles"), first)
    nodes = written(nodes.select("fp", *F_COLS, "shingles", "first.low", "first.digest"), "nodes")
    keys = in_blocks(ring_keys(nodes), ring_keys, nodes, F_COLS)
    dealt = keys.repartition("key", "pair").sortWithinPartitions("key", "pair").select(*F_COLS, "key", "pair")
    roots = components(stars(dealt.mapInArrow(_edges_by_key, "u long, v long")))
    near = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("root", "fp")).drop("root")
    near = written(near, "near")
    linked = components(verified_links(near, docs, id_col, text_col))
    rooted = near.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` of every row: groups of near duplicates at ``SIMILARITY``.

    A null, empty or wordless text is grouped with all others like it; repeated
    rows stay; an empty table gives none; other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    return prints.join(groups(prints, id_col, docs, text_col), "fp").select(id_col, "fp", "component_id")
