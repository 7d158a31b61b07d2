"""Choices under a budget of tokens that a real tokenizer counts.

Counts of a byte-pair tokenizer do not add up: what stands at a seam is merged
anew.  But a tokenizer first cuts its text into pre-tokens, from left to right,
and never merges across a cut.  So a text is cut once; of a chunk only a profile
is kept: its tokens, its head and its tail, each with the cuts in it.  When a
chunk is put behind a document, the text from the last safe cut of the tail to
the first cut that the head keeps is cut and counted again, and nothing else is.
A choice so moves profiles and not texts, and a trial costs a seam.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrow import bounded_batches

#: A cut is safe if so many characters follow it that no rule of the tokenizer can look past them.
MARGIN = 16
#: Characters of a head at least.
HEAD = 48
SEPARATOR = "\n\n"
PROFILE = "tokens long, head string, cuts array<int>, counts array<long>, tail string, before long"


class Cutter:
    """Cuts texts into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.normalizer is not None:
            raise ValueError("a tokenizer that rewrites texts before it cuts them has no seams to mend")
        self.size = lru_cache(1 << 16)(lambda piece: len(self.tokenizer.model.tokenize(piece)))

    def __call__(self, text: str) -> tuple[list[int], list[int], int]:
        """The cuts, the tokens before each, and all tokens."""
        cuts, before, total = [], [], 0
        for piece, (start, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            cuts.append(start)
            before.append(total)
            total += self.size(piece)
        return cuts, before, total

    def count(self, text: str) -> int:
        return self(text)[2]


class Profile(NamedTuple):
    """Of a text: all its tokens; the text up to where a seam ends at most, with its cuts and the tokens before each; what a seam can change at the end, and the tokens before that."""

    tokens: int
    head: str
    cuts: list[int]
    counts: list[int]
    tail: str
    before: int


def profile(text: str, cut: Cutter) -> Profile:
    cuts, counts, total = cut(text)
    first = next((c for c in cuts[1:] if c >= HEAD), len(text))
    end = min(len(text), first + MARGIN)
    n = bisect_left(cuts, end)
    last = max(0, bisect_left(cuts, len(text) - MARGIN + 1) - 1)
    return Profile(total, text[:end], cuts[:n], counts[:n], text[cuts[last] :] if cuts else text, counts[last] if cuts else 0)


@lru_cache(1 << 14)
def _seam(cut: Cutter, tail: str, head: str, cuts: tuple[int, ...]) -> tuple[int, int] | None:
    """Tokens from the start of ``tail`` to the first cut that ``head`` keeps behind it, and which cut that is."""
    at = len(tail)
    found, counts, _ = cut(tail + head)
    for c, n in zip(found, counts):
        if c >= at and c + MARGIN <= at + len(head) and (i := bisect_left(cuts, c - at)) < len(cuts) and cuts[i] == c - at:
            return n, i
    return None


def joined(a: Profile, b: Profile, cut: Cutter, separator: str = SEPARATOR) -> Profile:
    """The profile of two texts with ``separator`` between them; its head is left empty, as only tails go on."""
    tail = a.tail + separator
    if len(b.head) == len(b.tail) and b.before == 0:  # all of b is in its tail
        whole = profile(tail + b.tail, cut)
        return Profile(a.before + whole.tokens, "", [], [], whole.tail, a.before + whole.before)
    found = _seam(cut, tail, b.head, tuple(b.cuts))
    if found is None:
        raise ValueError("a chunk's beginning is cut otherwise behind another text; give longer heads")
    tokens, i = found
    shift = a.before + tokens - b.counts[i]
    if b.before < b.counts[i]:  # b's last safe cut is within the seam
        raise ValueError("a chunk's end lies in its head; give shorter heads")
    return Profile(b.tokens + shift, "", [], [], b.tail, b.before + shift)


@lru_cache(4)
def cutter(path: str) -> Cutter:
    return Cutter(path)


def profiles(chunks: DataFrame, keys: list[str], text: str, tokenizer_path: str) -> DataFrame:
    """``keys`` and the ``profile`` of each chunk, cut once wherever it is tried later; a null text is empty."""
    bounded_batches(chunks.sparkSession)
    kinds = [f"k{i} {chunks.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches):
        cut = cutter(tokenizer_path)
        for batch in batches:
            columns = list(zip(*(profile(t or "", cut) for t in batch.column(len(names)).to_pylist()))) or [[] for _ in Profile._fields]
            types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*names, *Profile._fields])

    told = chunks.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(text).cast("string").alias("t"))
    rows = told.mapInArrow(run, ", ".join([*kinds, PROFILE]))
    return rows.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.struct(*Profile._fields).alias("profile"))


class Choice:
    """The greedy choice of one pool, whose chunks come in the order of their rank."""

    def __init__(self, claim_tokens: int, budget: int, k: int, cut: Cutter):
        self.fixed, self.budget, self.k, self.cut = claim_tokens, budget, k, cut
        self.document: Profile | None = None
        self.chosen: list[int] = []
        self.seen, self.bad = 0, False

    def offer(self, pos: int, score: float | None, chunk: Profile) -> None:
        self.seen += 1
        if score is None or not math.isfinite(score):
            self.bad = True
        elif len(self.chosen) < self.k:
            trial = chunk if self.document is None else joined(self.document, chunk, self.cut)
            if trial.tokens + self.fixed <= self.budget:
                self.document = trial
                self.chosen.append(pos)

    def row(self) -> tuple:
        status = "bad_score" if self.bad else "ok" if self.chosen else "nothing_fits"
        chosen = [] if self.bad else self.chosen
        return self.seen, self.fixed + (self.document.tokens if chosen else 0), chosen, status


def exact_choice(scored: DataFrame, tokenizer_path: str, budget: int = 512, k: int = 3, specials: int = 0) -> DataFrame:
    """``qid``, ``variant``, ``candidates``, ``input_tokens``, ``chosen`` and ``status``: greedy in rank order, what does not fit is passed over.

    ``scored`` has qid, variant, pos, score, profile and claim_tokens (of the
    claim, encoded by itself); scores that tie go by place.  A document and a
    claim are encoded apart, with ``specials`` more tokens.  A pool's rows come
    one after the other and are never held together.  A pool with a score that is
    no finite number has status ``bad_score`` and chooses nothing.
    """
    bounded_batches(scored.sparkSession)
    keys, kinds = ("qid", "variant"), {c: scored.schema[c].dataType.simpleString() for c in ("qid", "variant")}
    names = [*keys, "candidates", "input_tokens", "chosen", "status"]
    result = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]

    def run(batches):
        cut, current, choice = cutter(tokenizer_path), None, None
        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for q, v, pos, score, claim_tokens, p in zip(*columns):
                if choice is None or (q, v) != current:
                    if choice is not None:
                        done.append((*current, *choice.row()))
                    current, choice = (q, v), Choice(claim_tokens + specials, budget, k, cut)
                choice.offer(pos, score, Profile(**p))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [batch.schema.field(0).type, batch.schema.field(1).type, *result])], names=names)
            types = [batch.schema.field(0).type, batch.schema.field(1).type, *result]
        if choice is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*current, *choice.row()), types)], names=names)

    rows = scored.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("score").cast("double").alias("score"), F.col("claim_tokens").cast("long").alias("claim_tokens"), "profile")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc_nulls_last("score"), "pos")
    return dealt.mapInArrow(run, f"qid {kinds['qid']}, variant {kinds['variant']}, candidates long, input_tokens long, chosen array<long>, status string")


def token_counts(texts: DataFrame, key: str, text: str, tokenizer_path: str, name: str = "tokens") -> DataFrame:
    """``key`` and the tokens of each text; those of a null are none."""
    return profiles(texts, [key], text, tokenizer_path).select(key, F.col("profile.tokens").alias(name))
