"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased and reduced to letters with one space between words.  For
each language the four-grams of all its training texts are counted; lower
orders take Kneser-Ney continuation counts.  Interpolated log-probabilities of
all languages stand side by side in arrays sorted by the hash of the n-gram, one
for each order, and back-off weights in arrays sorted by the hash of the
context, so a text is looked up once for all languages.  The language with the
lowest cross-entropy per character wins; it is accepted if that is within what
texts of the language have.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.runtime import bounded_batches, per_slice, slices, written

ORDER = 4  # four code points of 16 bits fill a key
#: Documents, about, on which score and rejection are calibrated; a tenth at most.
CALIBRATION_DOCS = 4000
UNKNOWN = "und"

SPACE, EDGE, ASTRAL = 0x20, 1, 0xFFFF
SEPARATOR = "\U0010ffff" * (ORDER - 1)


def _classes() -> np.ndarray:
    letters = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    return np.where(letters, np.arange(0x10000), SPACE).astype(np.uint64)


_CLASSES: list[np.ndarray] = []


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The reduced characters of all texts with edges between, where each text ends, and whether it has a letter."""
    if not _CLASSES:
        _CLASSES.append(_classes())
    text = SEPARATOR + SEPARATOR.join((t or "").replace("\U0010ffff", " ") for t in texts) + SEPARATOR
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    chars = _CLASSES[0][np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]):
        chars[codes == c] = EDGE if c == 0x10FFFF else ASTRAL if chr(c).isalpha() else SPACE
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != SPACE) | (chars[:-1] != SPACE)
    chars = chars[keep]
    edge = chars == EDGE
    ends = np.flatnonzero(edge)[ORDER - 1 :: ORDER - 1]  # the first edge after each text
    letters = np.r_[0, np.cumsum(~edge & (chars != SPACE))]
    return chars, ends, np.diff(letters[ends], prepend=0) > 0


def four_grams(chars: np.ndarray) -> np.ndarray:
    """The key of the four-gram that ends at each character from the fourth on."""
    return chars[:-3] << np.uint64(48) | chars[1:-2] << np.uint64(32) | chars[2:-1] << np.uint64(16) | chars[3:]


def _count(batches):
    """(lang, gram, n) summed over a task; ``lang`` is any key of strings."""
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def folded(pairs):
        keys, inverse = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in pairs]), len(keys)).astype(np.int64)

    for part in slices(batches):
        langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
        for lang in set(langs):
            chars, _, _ = characters([t for x, t in zip(langs, texts) if x == lang])
            grams = four_grams(chars)
            keys, n = np.unique(grams[chars[3:] != EDGE], return_counts=True)
            old = parts.setdefault(lang, [])
            old.append((keys, n))
            if sum(len(k) for k, _ in old) > 1_000_000:
                parts[lang] = [folded(old)]
    for lang, pairs in parts.items():
        keys, n = folded(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _mix(keys: np.ndarray) -> np.ndarray:
    x = keys.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ x >> np.uint64(31)


@dataclass
class HashArray:
    """Rows of values by key, in the order of the keys' hashes (which no two keys share)."""

    hashes: np.ndarray
    values: np.ndarray
    shift: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = _mix(keys)
        order = np.argsort(hashes)
        bits = max(1, int(len(keys)).bit_length())
        first = np.searchsorted(hashes[order] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        return cls(hashes[order], values[order].astype(np.float32), 64 - bits, first)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        hashes = _mix(keys)
        bucket = (hashes >> np.uint64(self.shift)).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < stop)
        at, stop, hashes = at[left], stop[left], hashes[left]
        while len(left):
            hit = self.hashes[at] == hashes
            out[left[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < stop)
            left, at, stop, hashes = left[go], at[go], stop[go], hashes[go]
        return out


@dataclass
class Model:
    langs: list[str]
    grams: list[HashArray]  # log-probabilities, by order - 1
    backoffs: list[HashArray]  # of the context of each order from 2, by order - 2
    unseen: np.ndarray  # log-probability of a character that no text had
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """For each four-gram and language: of its last character after the three before it."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        left, keys = np.arange(len(grams)), grams
        for order in range(ORDER, 0, -1):
            row = self.grams[order - 1].find(keys)
            hit = row >= 0
            out[left[hit]] += self.grams[order - 1].values[row[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                return out
            if order > 1:
                row = self.backoffs[order - 2].find(keys >> np.uint64(16))
                known = row >= 0
                out[left[known]] += self.backoffs[order - 2].values[row[known]]
                keys = keys & np.uint64((1 << 16 * (order - 1)) - 1)
        out[left] += self.unseen
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character by text and language, and whether the text has a letter."""
        chars, ends, letters = characters(texts)
        inner = chars[3:] != EDGE
        scores = self.log_probabilities(four_grams(chars)[inner])
        total = np.r_[np.zeros((1, len(self.langs))), np.cumsum(scores, axis=0, dtype=np.float64)]
        at = np.r_[0, np.cumsum(inner)][ends - 3]
        n = np.diff(at, prepend=0)
        sums = np.diff(total[at], axis=0, prepend=0)
        return -sums / np.maximum(n, 1)[:, None], letters


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, values, len(unique))


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], default)


def fit(langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from the (sorted keys, counts) of each language's four-grams."""
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for keys, n in counts:
        for order in range(ORDER, 0, -1):
            by_order[order - 1].append((keys, n))
            if order > 1:  # continuation counts: how many characters come before
                keys, n = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
    unions = [np.unique(np.concatenate([k for k, _ in level])) for level in by_order]
    contexts = [np.unique(u >> np.uint64(16)) for u in unions[1:]]
    base = 1.0 / (len(unions[0]) + 1)
    probs = [np.zeros((len(u), len(langs))) for u in unions]
    weights = [np.ones((len(c), len(langs))) for c in contexts]
    unseen = np.zeros(len(langs))
    for j in range(len(langs)):
        for order in range(1, ORDER + 1):
            keys, n = by_order[order - 1][j]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = keys >> np.uint64(16)
            heads, totals = _sums(context, n)
            _, kinds = _sums(context, np.ones(len(n)))
            lam = discount * kinds / totals
            union = unions[order - 1]
            seen = np.maximum(_at(keys, n.astype(float), union, 0.0) - discount, 0.0)
            head = union >> np.uint64(16)
            share = seen / _at(heads, totals, head, 1.0)
            if order == 1:
                rest = float(lam[0]) * base
                unseen[j] = rest
            else:
                weights[order - 2][:, j] = _at(heads, lam, contexts[order - 2], 1.0)
                lower = np.searchsorted(unions[order - 2], union & np.uint64((1 << 16 * (order - 1)) - 1))
                rest = _at(heads, lam, head, 1.0) * probs[order - 2][lower, j]
            probs[order - 1][:, j] = share + rest
    return Model(langs, [HashArray.of(u, np.log(p)) for u, p in zip(unions, probs)], [HashArray.of(c, np.log(w)) for c, w in zip(contexts, weights)], np.log(unseen))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model of all rows with a text and a language; None if there are none.

    Every row counts, and every four-gram stays at every size.  To the driver
    come each language's different four-grams, which grow with the corpus and
    which it and each worker must hold, and a few numbers for each of about
    ``CALIBRATION_DOCS`` rows.  Those, chosen by a hash of the id, calibrate by
    a model that has not seen them; what they teach goes over to the whole model.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    apart = F.pmod(F.xxhash64("id"), F.lit(max(10, rows.count() // CALIBRATION_DOCS))) == 0
    keyed = rows.select(F.concat(F.when(apart, "1").otherwise("0"), F.col("lang")).alias("lang"), "text")
    counts = keyed.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = written(counts, "grams").toArrow()
    split = {}
    for key in pc.unique(table["lang"]).to_pylist():
        part = table.filter(pc.equal(table["lang"], key))
        keys = part["gram"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        split[key] = keys[order], part["n"].to_numpy()[order]
    langs = sorted({key[1:] for key in split})
    if not langs:
        return None
    whole = [_merged([split[k + x] for k in "01" if k + x in split]) for x in langs]
    model = fit(langs, whole)
    seen = [x for x in langs if "0" + x in split]
    if seen and any("1" + x in split for x in seen):
        _calibrate(model, fit(seen, [split["0" + x] for x in seen]), rows.where(apart))
    return model


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = _sums(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
    return keys, n.astype(np.int64)


def _calibrate(model: Model, other: Model, sample: DataFrame) -> None:
    """Set ``model``'s sharpness and limits by what ``other``, which has not seen ``sample``, says of it."""
    shared = sample.sparkSession.sparkContext.broadcast(other)

    def kernel(texts: pa.Array):
        h, letters = shared.value.cross_entropies(texts.to_pylist())
        return [h.tolist(), letters]

    sample = sample.where(F.col("lang").isin(other.langs))
    got = per_slice(sample, "lang", "text", kernel, "h array<double>, ok boolean").where("ok").select("lang", "h").toArrow()
    if not len(got):
        return
    h = np.array(got["h"].to_pylist())
    names = np.array(got["lang"].to_pylist())
    true = np.array([other.langs.index(x) for x in names])
    own = h[np.arange(len(h)), true]
    likelihoods = {t: float(np.mean(-t * own - np.log(np.exp(-t * (h - h.min(1, keepdims=True))).sum(1)) + t * h.min(1))) for t in (1, 2, 4, 8, 16, 32)}
    model.sharpness = max(likelihoods, key=likelihoods.get)
    model.limits = np.array([1.25 * np.quantile(own[names == x], 0.99) if (names == x).any() else np.inf for x in model.langs])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``cross_entropy`` and ``accepted`` of every row's whole text.

    A text that is null or has no letter gets ``und`` with score 0, and so do all
    without a model.  Equal cross-entropies go to the language that sorts first.
    Repeated rows stay; an empty table gives none.  Other columns are not read.
    """
    schema = "lang_pred string, score double, cross_entropy double, accepted boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: pa.Array):
        known, n = shared.value, len(texts)
        if known is None:
            return [[UNKNOWN] * n, np.zeros(n), pa.nulls(n, pa.float64()), np.zeros(n, bool)]
        h, letters = known.cross_entropies(texts.to_pylist())
        best = h.argmin(1)
        low = h[np.arange(n), best]
        score = np.where(letters, 1 / np.exp(-known.sharpness * (h - low[:, None])).sum(1), 0.0)
        names = [known.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        within = True if known.limits is None else low <= known.limits[best]
        return [names, score, pa.array(low, mask=~letters), letters & within]

    return per_slice(docs, id_col, text_col, kernel, schema)
