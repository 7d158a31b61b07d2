"""Benchmark decontamination with a generalised suffix automaton.

The normalised items of a benchmark are put, item after item, into one suffix
automaton over words.  A document's words are streamed through it; at each word
it gives the length of the longest run of words, ending there, that occurs in
some item.  Where that length reaches a window's, the window's words are hit.

The automaton holds a bounded number of item words.  A larger benchmark is cut
into blocks of items, each with an automaton of its own that all documents pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from plumbline.llm.runtime import as_bytes, bounded_batches, fields_of, forget, keyed_text, slices, word_codes, written

WINDOW = 10
#: Words of items in one automaton; it has at most twice as many states.
BLOCK_WORDS = 100_000

#: A-Z to a-z; all but 0-9, a-z and bytes of code points from U+0080 to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(NORMAL).split() if data else []


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.codes.setdefault(w, len(self.codes)))
        #: By state: the state of the window that ends there (0: no so long string does), and the whole short items.
        self.full = [0] * len(self.link)
        self.small: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)  # (words, state), also of suffixes
        self.owners: dict[int, set[int]] = {}  # state of a window or short item -> items
        short: dict[int, int] = {}
        paths = []
        for k, (_, words) in enumerate(items):
            path = [0]
            for w in words:
                path.append(self.next[path[-1]][self.codes[w]])
            paths.append(path)
            if 0 < len(words) < window:
                short[path[-1]] = len(words)
                self.owners.setdefault(path[-1], set()).add(k)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.full[s] = s if self.length[s] >= window > self.length[up] else self.full[up]
            self.small[s] = ((short[s], s), *self.small[up]) if s in short else self.small[up]
        for k, path in enumerate(paths):
            for t in {self.full[s] for s in path} - {0}:
                self.owners.setdefault(t, set()).add(k)
        self.least = min([window, *short.values()])
        self.pairs = np.unique([a * len(self.codes) + b for edges in self._pairs(items) for a, b in edges] or [-1])

    def _pairs(self, items):
        for _, words in items:
            codes = [self.codes[w] for w in words]
            yield zip(codes, codes[1:])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._add({}, 0, length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _add(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._add(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def scan(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """(start, end) of each window found in ``codes``, and the states of the windows."""
        nxt, link, length, full, small, window = self.next, self.link, self.length, self.full, self.small, self.window
        state, n, spans, found = 0, 0, [], set()
        for i, c in enumerate(codes, 1):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(c)
            if to is None:
                continue
            state, n = to, n + 1
            if n >= window:
                spans.append((i - window, i))
                found.add(full[state])
            for m, s in small[state]:
                if m <= n:
                    spans.append((i - m, i))
                    found.add(s)
        return spans, found

    def stretches(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a window can be: runs of words all of whose neighbours are neighbours in some item."""
        if not len(codes):
            return codes, codes
        if self.least > 1:
            ok = (codes[:-1] >= 0) & (codes[1:] >= 0)
            at = np.flatnonzero(ok)
            key = codes[at].astype(np.int64) * len(self.codes) + codes[at + 1]
            ok[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
            inner = ends[(ends > 0) & (ends < len(codes))]
            ok[inner - 1] = False  # never over the end of a text
        else:
            ok = codes >= 0
        edge = np.diff(np.r_[False, ok, False].astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if self.least > 1:
            b = b + 1  # n pairs are n + 1 words
        long = b - a >= self.least
        a, b = a[long], b[long]
        if self.least == 1 and len(a):
            cut = [np.r_[x, ends[(ends > x) & (ends < y)], y] for x, y in zip(a, b)]
            a, b = np.concatenate([c[:-1] for c in cut]), np.concatenate([c[1:] for c in cut])
        return a, b


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_texts(auto: Automaton, texts: list[bytes | None]) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """Words of each text, and for the texts with a hit: word spans and names of items."""
    plain = pa.array([b"" if t is None else t.translate(NORMAL) for t in texts], pa.binary()).cast(pa.string())
    codes, ends, strings = word_codes(pc.ascii_split_whitespace(plain))
    known = auto.codes.get
    table = np.array([known(s, -1) for s in strings.cast(pa.binary()).to_pylist()], np.int32)
    empty = pc.equal(strings, "").to_numpy(zero_copy_only=False).astype(bool)
    if empty.any():  # beside white space at the ends of a text
        keep = ~empty[codes]
        ends = np.r_[0, np.cumsum(keep)][ends]
        codes = codes[keep]
    codes = table[codes] if len(table) else codes
    hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for a, b in zip(*auto.stretches(codes, ends)):
        spans, found = auto.scan(codes[a:b].tolist())
        if spans:
            row = int(np.searchsorted(ends, a, "right"))
            shift = int(a) - (int(ends[row - 1]) if row else 0)
            old = hits.setdefault(row, ([], set()))
            old[0].extend((x + shift, y + shift) for x, y in spans)
            old[1].update(auto.names[k] for s in found for k in auto.owners[s])
    return np.diff(ends, prepend=0), {row: (merged(spans), names) for row, (spans, names) in hits.items()}


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of bounded size; a longer item is cut into pieces that share all but one word of a window."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        words = words_of((row.t or "").encode())
        for start in range(0, max(len(words) - window + 1, 1), BLOCK_WORDS):
            piece = words[start : start + BLOCK_WORDS + window - 1]
            if block and size + len(piece) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((row.i or "", piece))
            size += len(piece)
    yield block


FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _columns(auto: Automaton, texts: pa.Array, fields):
    n, hits = scan_texts(auto, as_bytes(texts))
    rows = [hits.get(i, ((), ())) for i in range(len(n))]
    spans = pa.array([[{"start": a, "end": b} for a, b in spans] for spans, _ in rows], fields[1].type)
    return [pa.array(n, pa.int64()), spans, pa.array([sorted(names) for _, names in rows], fields[2].type)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id_col``, ``n_words``, ``spans`` (hit words, end exclusive) and ``items`` of every row.

    A window is ``window`` words in a row of an item, or all words of an item of
    fewer.  Null and empty texts have no words, and items without words no
    window; repeated rows stay, repeated items count as one where they share an
    id (a null id has the empty name); an empty benchmark hits nothing.  Other columns of either table are not
    read.
    """
    spark = docs.sparkSession
    blocks = list(_broadcast_blocks(spark, benchmark, item_col, item_text_col, window))
    source = keyed_text(docs, id_col, text_col)
    if len(blocks) == 1:
        out = source.mapInArrow(_finder(blocks[0], spark), f"key {docs.schema[id_col].dataType.simpleString()}, {FOUND}")
        return out.withColumnRenamed("key", id_col)
    source = written(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = [source.select("row", "text").mapInArrow(_finder(b, spark), f"row long, {FOUND}") for b in blocks]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    joined = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return source.select(F.col("row"), F.col("key").alias(id_col)).join(joined, "row").select(id_col, "n_words", _merge("s").alias("spans"), "items")


def _merge(spans: str):
    """Sorted spans as a list of spans that do not touch."""
    kind = "array<struct<start:int,end:int>>"
    add = lambda out, s: F.when(
        (F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(spans, F.array().cast(kind), add)


def _broadcast_blocks(spark, benchmark, item_col, item_text_col, window):
    for block in item_blocks(benchmark, item_col, item_text_col, window):
        yield spark.sparkContext.broadcast(Automaton(block, window))


def _finder(auto, spark):
    fields = fields_of(spark, FOUND)

    def run(batches):
        for part in slices(batches):
            columns = _columns(auto.value, part.column(1), fields)
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=pa.schema([part.schema.field(0), *fields]))

    return run


def leak_digest(found: DataFrame) -> DataFrame:
    """Counts of hit words and of items in place of the lists."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": hit > 0}).drop("spans", "items")


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` without the words in ``spans`` and what stands between them."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(NORMAL))]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the hit spans of ``text_col``, and without the rows of which over ``max_coverage`` is hit.

    Cutting goes on until no window is left, also none that cutting has made.
    All other columns and rows stay as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = list(_broadcast_blocks(spark, benchmark, item_col, item_text_col, window))
    if len(blocks) > 1:
        return _cut_by_all(docs, blocks, max_coverage, text_col)
    done = docs.select(F.struct("*").alias("doc"), _cleaner(blocks[0], max_coverage)(F.col(text_col)).alias("clean")).where(~F.col("clean.gone"))
    return done.select(F.col("doc").withField(f"`{text_col}`", F.col("clean.text")).alias("doc")).select("doc.*")


def _cut_by_all(docs: DataFrame, blocks: list, max_coverage: float, text_col: str) -> DataFrame:
    """``remove_leaks`` by several automata: coverage and each cut take the hits of all of them.

    What was cut goes through all blocks again until none of them hits.
    """
    rows = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    texts = rows.select("row", F.col("doc")[text_col].cast("string").alias("text"))
    hits = written(_hits(texts, blocks), "hits")
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    over = covered > F.lit(max_coverage) * F.col("n_words")
    gone = hits.where(over).select("row")
    hits, cleaned = hits.where(~over), []
    while not hits.isEmpty():
        texts = written(texts.join(hits, "row").select("row", _cutter()(F.col("text"), F.col("spans")).alias("text")), "cut")
        hits = written(_hits(texts, blocks), "hits")
        cleaned.append(texts.join(hits, "row", "left_anti"))
    kept = rows.join(gone, "row", "left_anti")
    if cleaned:
        new = reduce(DataFrame.union, cleaned).select("row", "text")
        text = F.coalesce("text", F.col("doc")[text_col].cast("string"))
        kept = kept.join(new, "row", "left").select(F.col("doc").withField(f"`{text_col}`", text).alias("doc"))
    return kept.select("doc.*")


def _hits(texts: DataFrame, blocks: list) -> DataFrame:
    """``row``, ``n_words`` and the ``spans`` of all blocks, of the texts with a hit."""
    parts = [texts.select("row", "text").mapInArrow(_finder(b, texts.sparkSession), f"row long, {FOUND}").where(F.size("spans") > 0) for b in blocks]
    joined = reduce(DataFrame.union, parts).groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    return joined.select("row", "n_words", _merge("s").alias("spans"))


def _cutter():
    @arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [_cut(t, [(s["start"], s["end"]) for s in hit]) for t, hit in zip(as_bytes(texts), spans.to_pylist())]
        return pa.array(out, pa.binary()).cast(pa.string())

    return cut


def _cleaner(auto, max_coverage: float):
    @arrow_udf("struct<text:string,gone:boolean>")
    def clean(texts: pa.Array) -> pa.Array:
        out = as_bytes(texts)
        gone = np.zeros(len(out), bool)
        n, hits = scan_texts(auto.value, out)
        for row, (spans, _) in hits.items():
            gone[row] = sum(b - a for a, b in spans) > max_coverage * n[row]
            while spans and not gone[row]:
                out[row] = _cut(out[row], spans)
                spans = scan_texts(auto.value, [out[row]])[1].get(0, ((), ()))[0]
        forget()
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(gone)], names=["text", "gone"])

    return clean
