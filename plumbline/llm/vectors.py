"""Product codes of vectors: k-means over integer parts, exact by exponion search.

Vectors become integers and are cut into parts; each part position has its own
codebook, trained over all rows.  A point starts at the entry it had in the round
before, at the squared distance u.  The nearest entry is no farther from it than
that one, so by the triangle inequality it lies within twice that distance of the
previous entry: only those of its neighbours, sorted by distance, are scanned
whose squared distance from it is 4u at most.  The list is scanned in rings of
growing width, and a point leaves it as soon as what it has found proves the rest
to be farther: from the best b so far, squared, (sqrt u + sqrt b)^2 <= 2u + 2b.

All distances are exact integers: by a matrix product in doubles where no sum
can reach 2^53, else in 64 bits, else in integers of any size.  Ties go to the
lower index.  Rounds keep their rows, with the entries they have, in the shared
folder; of a round only the sums of each entry (as many numbers as the codebooks
have) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.runtime import bounded_batches, written
from plumbline.operators.places import null_safe

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows and bytes of components that a kernel handles at once.
GATHER_ROWS, GATHER_BYTES = 32768, 16 << 20
FIRST_RING = 16
LIMB = 62


def largest(*arrays: np.ndarray) -> int:
    return max((int(abs(a).max()) for a in arrays if a.size), default=0)


def compact(a: np.ndarray) -> np.ndarray:
    """Integers of any kind as 64-bit ones where they fit."""
    return a.astype(np.int64) if a.dtype == object and largest(a) < 1 << 62 else a


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` from all of ``c``, exact."""
    bound = 4 * max(1, x.shape[1]) * largest(x, c) ** 2
    if bound < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    kind = np.int64 if bound < 1 << 63 else object
    x, c = x.astype(kind), c.astype(kind)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


class Search:
    """The nearest entry of one part's codebook, from the entry that a point had before."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        d = distances(entries, entries)
        number = np.arange(len(entries))
        self.near = [np.array(sorted(number, key=lambda j: (row[j], j))) for row in d]
        self.apart = [row[order] for row, order in zip(d, self.near)]
        self.held: dict[tuple[int, int, bool], tuple] = {}
        self.scanned = 0

    def own(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The squared distance of each point from the entry it is at."""
        if 4 * max(1, x.shape[1]) * largest(x, self.entries) ** 2 >= 1 << 63:
            x = x.astype(object)
        return compact(((x - self.entries[at]) ** 2).sum(1))

    def rings(self, a: int, exact: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the entries around ``a`` in rings: the place of the first, their numbers ascending, and for products in doubles their components and squared norms."""
        low, high = 0, FIRST_RING
        while low < len(self.entries):
            if (a, low, exact) not in self.held:
                ring = np.sort(self.near[a][low:high])
                c = self.entries[ring]
                self.held[a, low, exact] = (ring, c.T.astype(np.float64), (c * c).sum(1).astype(np.float64)) if exact else (ring, None, None)
            yield low, *self.held[a, low, exact]
            low, high = high, 2 * high

    def __call__(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = self.own(x, before)
        exact = 16 * max(1, x.shape[1]) * largest(x, self.entries) ** 2 < 1 << 53  # also of the bounds below
        kind = np.float64 if exact else object if u.dtype == object or largest(u) >= 1 << 60 else np.int64
        order = np.argsort(before, kind="stable")
        x, at, u = x[order], before[order], u[order].astype(kind)
        if exact:
            x = x.astype(np.float64)
            norms = (x * x).sum(1)[:, None]
        best = u.copy()
        starts = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
        for start, end in zip(starts, [*starts[1:], len(at)]):
            a, rows = int(at[start]), slice(start, end)
            apart = self.apart[a].astype(kind)
            for low, ring, c, squares in self.rings(a, exact):
                if low:
                    bound = 2 * (u[start:end] + best[start:end])
                    rows = start + np.flatnonzero(np.searchsorted(apart, bound, "right") > low)
                    if not len(rows):
                        break
                d = norms[rows] - 2 * (x[rows] @ c) + squares if exact else distances(x[rows], self.entries[ring]).astype(kind)
                self.scanned += d.size
                first = d.argmin(1)
                d, j = d[np.arange(len(d)), first], ring[first]
                better = (d < best[rows]) | (d == best[rows]) & (j < at[rows])
                best[rows], at[rows] = np.where(better, d, best[rows]), np.where(better, j, at[rows])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return at[back], best[back].astype(np.int64) if kind is not object else best[back]


def unpacked(column: pa.Array) -> np.ndarray:
    """Rows of integer components from their bytes: 32-bit ones, or doubles that hold larger integers."""
    rows = column.to_pylist()
    if len(set(map(len, rows))) == 1 and column.type == pa.binary():
        width = 4 if rows[0][:1] == b"i" else 8
        flat = np.frombuffer(b"".join(r[1:] for r in rows), "<i4" if width == 4 else "<f8")
        return whole(flat.reshape(len(rows), (len(rows[0]) - 1) // width))
    return compact(np.stack([whole(np.frombuffer(r[1:], "<i4" if r[:1] == b"i" else "<f8")).astype(object) for r in rows]))


def whole(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind == "f" and largest(a) >= 1 << 62:
        return np.array([int(v) for v in a.ravel()], dtype=object).reshape(a.shape)
    return a.astype(np.int64)


def packed(v: np.ndarray) -> bytes:
    return b"i" + v.astype("<i4").tobytes() if not len(v) or abs(v).max() < 2**31 else b"f" + v.astype("<f8").tobytes()


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``GATHER_ROWS`` and ``GATHER_BYTES``, so that an entry has many points at once."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and (rows + batch.num_rows > GATHER_ROWS or size + batch.column(column).nbytes > GATHER_BYTES):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.column(column).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _integers(scale: int):
    def run(batches):
        for batch in batches:
            rows = [packed(np.floor(np.asarray(v, np.float64) * scale)) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["key", "label", "ints"])

    return run


def integers(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``key``, ``label`` and the components' integers ``ints``, written to the shared folder.

    Rows whose vector is null or holds nulls, NaN or infinities are left out.
    """
    bounded_batches(df.sparkSession)
    x = df.select(F.col(id_col).alias("key"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    return written(x.where(F.col("v").isNotNull() & ~bad).mapInArrow(_integers(scale), f"key {kinds['key']}, label {kinds['label']}, ints binary"), "vectors")


def parted(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _assign(books: list[np.ndarray], last: bool):
    """Rows with the nearest entry of each part; ``last`` adds the error and leaves out the components."""
    def run(batches):
        searches = [Search(b) for b in books]
        for batch in gathered(batches, 2):
            x = parted(unpacked(batch.column(2)), len(books))
            before = np.zeros((batch.num_rows, len(books)), np.int64)
            if batch.num_columns > 3:
                before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).astype(np.int64).reshape(before.shape)
            found = [s(p, before[:, i]) for i, (s, p) in enumerate(zip(searches, x))]
            codes = pa.array([c.tobytes() for c in np.stack([at for at, _ in found], 1).astype(np.uint8)], pa.binary())
            if last:
                error = sum(d.astype(object) for _, d in found)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array([e if e < 1 << 63 else None for e in error], pa.int64())], names=["key", "label", "codes", "error"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), codes], names=["key", "label", "ints", "codes"])

    return run


def _sums(parts: int):
    """Of each task: the number of points of each part's entries and the sums of their components, in limbs that fit 64 bits."""
    def run(batches):
        totals: dict[tuple[int, int], list] = {}
        for batch in gathered(batches, 0):
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, parts)
            for i, x in enumerate(parted(unpacked(batch.column(0)), parts)):
                if largest(x) * len(x) >= 1 << 62:
                    x = x.astype(object)
                order = np.argsort(codes[:, i], kind="stable")
                starts = np.r_[0, np.flatnonzero(np.diff(codes[order, i])) + 1]
                for j, n, s in zip(codes[order[starts], i].tolist(), np.diff(np.r_[starts, len(order)]).tolist(), np.add.reduceat(x[order], starts, axis=0)):
                    held = totals.setdefault((i, j), [0, np.zeros(x.shape[1], object)])
                    held[0] += n
                    held[1] = held[1] + s.astype(object)
        rows = []
        for (i, j), (n, s) in totals.items():
            limb = 0
            while largest(s) >= 1 << LIMB:
                rows.append((i, j, limb, n, [int(v) & ((1 << LIMB) - 1) for v in s]))
                s, limb = np.array([int(v) >> LIMB for v in s], dtype=object), limb + 1
            rows.append((i, j, limb, n, [int(v) for v in s]))
        if rows:
            names = ["part", "entry", "limb", "n", "sums"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def averaged(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by its points' floored mean; one without points stays."""
    rows = state.select("ints", "codes").mapInArrow(_sums(len(books)), "part int, entry int, limb int, n long, sums array<long>")
    each = rows.select("part", "entry", "limb", "n", F.posexplode("sums").alias("pos", "x"))
    told = each.groupBy("part", "entry", "limb", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    sums: dict[tuple[int, int], dict[int, int]] = {}
    counts: dict[tuple[int, int], int] = {}
    for r in told.collect():  # as many numbers as the codebooks have
        held = sums.setdefault((r.part, r.entry), {})
        held[r.pos] = held.get(r.pos, 0) + (int(r.x) << LIMB * r.limb)
        if not r.limb:
            counts[r.part, r.entry] = r.n
    out = [b.astype(object) for b in books]
    for (i, j), s in sums.items():
        for pos, x in s.items():
            out[i][j, pos] = x // counts[i, j]
    return [compact(b) for b in out]


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the rows with the smallest keys; there are fewer entries if there are fewer rows."""
    first = rows.orderBy(F.asc_nulls_last("key"), "ints").limit(entries).select("ints").collect()
    if not first:
        return []
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    x = [unpacked(pa.array([r.ints], pa.binary()))[0].astype(object) for r in first]
    if len(x[0]) % parts or len(set(map(len, x))) > 1:
        raise ValueError(f"vectors must be of one length that {parts} divides")
    return parted(compact(np.stack(x)), parts)


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], DataFrame]:
    """The codebooks after ``rounds`` rounds over all ``rows`` (of ``integers``), and the rows with their last entries."""
    books, state = first_books(rows, parts, entries), rows
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    for _ in range(rounds if books else 0):
        state = written(state.mapInArrow(_assign(books, False), f"key {kinds['key']}, label {kinds['label']}, ints binary, codes binary"), "vector-codes")
        books = averaged(state, books)
    return books, state


def encode(state: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``key``, ``label``, ``codes`` (one byte for each part) and ``error`` of rows of ``integers`` or ``train``."""
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    return state.mapInArrow(_assign(books, True), f"key {kinds['key']}, label {kinds['label']}, codes binary, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``id_col``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every row with a sound vector.

    Codes are from codebooks trained over all those rows.  Rows without a sound
    vector go; null and repeated ids and labels are rows like others (for the
    first codebook null ids come last and repeated ones are ordered by their
    components' bytes); rows that have the same label, or none, share
    ``label_error``.  An error or a sum over 63 bits is null.  Vectors of
    unequal length, or of one that ``parts`` does not divide, raise.  Other
    columns are not read; an empty table gives no rows.
    """
    rows = integers(df, id_col, vec_col, label_col)
    books, state = train(rows, parts, entries, rounds)
    if not books:
        return rows.select(F.col("key").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest_of(books)).alias("codebooks_sha256"))
    found = written(encode(state, books), "vector-errors")
    sums = found.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    told = null_safe(found, sums, ["label"])
    return told.select(F.col("key").alias(id_col), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
