"""Token counts with a shortcut for whole tokens.

For a vocabulary of the word-end BPE kind (white space parts and is dropped,
text is lower-cased) it is proved once, on the driver, which of its strings
encode alone as a single token.  A pre-token among them counts one without any
merging; only the other pre-tokens go through the library's merges, once per
worker.  Texts that the plain splitter may not cut as the library does (code
points beyond Latin-1, odd white space, special tokens) are cut by the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.runtime import Memory, per_slice, sums_within, word_codes

#: Strings whose costs a worker keeps, in each of two generations.
KEPT_STRINGS = 400_000

LETTERS = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
#: For lower-cased Latin-1 text.
WORD_END_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
ODD_SPACE = "\x1c-\x1f\x85\xa0"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The library's tokenizer of a ``.json`` or ``.model`` file, kept per process."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's tasks share its cores
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def library_ids(tok, texts: list[str]) -> Iterator[list[int]]:
    """The library's ids of each text; its encodings take kilobytes each, so few are held at once."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and stop - start < 2048 and size < 1 << 20:
            size += len(texts[stop])
            stop += 1
        for e in tok.encode_batch_fast(texts[start:stop], add_special_tokens=False):
            yield e.ids
        start = stop


def special_strings(tok) -> re.Pattern | None:
    """What the library finds in a text before it cuts anything."""
    found = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


def is_word_end_bpe(path: str) -> bool:
    """Whether the splitter of this module fits the file."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(load_tokenizer(path).to_str())
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return spec["model"].get("end_of_word_suffix") == "</w>" and parts[0].get("type") == "Split" and "Lowercase" in str(spec.get("normalizer"))


def proved_singles(path: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and encode alone as one token."""
    tok = load_tokenizer(path)
    plain = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    plain |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain.values())}
    texts = []
    for token in tok.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(plain[c] for c in token.removesuffix("</w>")).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    texts = [t for t in dict.fromkeys(texts) if t and t.lower() == t and WORD_END_PIECES.fullmatch(t)]
    one = tok.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, one) if len(e.ids) == 1)


def mask_of(texts: list[str], odd: re.Pattern) -> np.ndarray:
    """Which texts the plain splitter must leave to the library."""
    out = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        try:
            out[i] = bool(odd.search(text)) if text.encode("latin-1") else False
        except UnicodeEncodeError:
            out[i] = True
    return out


class WordEndCounter:
    """Tokens of texts; the cost of a string between white space is found once."""

    def __init__(self, path: str, singles: frozenset[str]):
        self.tok, self.singles = load_tokenizer(path), singles
        self.costs = Memory(self._learn, KEPT_STRINGS)
        special = special_strings(self.tok)
        self.odd = re.compile(f"[{ODD_SPACE}]" + (f"|{special.pattern}" if special else ""))

    def _learn(self, strings: list[str]) -> list[int]:
        cut = [WORD_END_PIECES.findall(s) for s in strings]
        rest = [p for pieces in cut for p in pieces if p not in self.singles]
        merged = library_ids(self.tok, rest)
        return [sum(1 if p in self.singles else len(next(merged)) for p in pieces) for pieces in cut]

    def __call__(self, texts: list[str]) -> np.ndarray:
        odd = mask_of(texts, self.odd)
        plain = pa.array(["" if o else t for o, t in zip(odd, texts)], pa.string())
        codes, ends, strings = word_codes(pc.ascii_split_whitespace(pc.utf8_lower(plain)))
        cost = np.array(self.costs(strings.to_pylist()), np.int64)
        out = sums_within(cost[codes], ends)
        rest = [t for o, t in zip(odd, texts) if o]
        out[odd] = [len(ids) for ids in library_ids(self.tok, rest)] if rest else 0
        return out


_COUNTERS: dict[str, WordEndCounter] = {}


def token_counter(path: str, singles: frozenset[str] | None):
    """``texts -> tokens`` as the library counts them; with the whole-token shortcut if ``singles`` is given."""
    tok = load_tokenizer(path)
    if singles is not None:
        if path not in _COUNTERS:
            _COUNTERS[path] = WordEndCounter(path, singles)
        return _COUNTERS[path]
    if path.endswith(".model"):
        return lambda texts: [len(x) for x in tok.encode(texts, num_threads=1)]
    return lambda texts: [len(ids) for ids in library_ids(tok, texts)]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row's whole text.

    A null or empty text has none of either.  Rows that repeat stay; an empty
    table gives none.  Columns of ``docs`` besides the two are not read.
    ``tokenizer_path`` is a file of the ``tokenizers`` (.json) or
    ``sentencepiece`` (.model) library that every executor has.
    """
    singles = None
    if is_word_end_bpe(tokenizer_path):  # its size is bounded by the vocabulary's
        singles = docs.sparkSession.sparkContext.broadcast(proved_singles(tokenizer_path))

    def kernel(texts: pa.Array):
        n_bytes = pc.fill_null(pc.binary_length(texts), 0)
        known = pc.fill_null(texts, "").to_pylist()
        return n_bytes, token_counter(tokenizer_path, singles and singles.value)(known)

    return per_slice(docs, id_col, text_col, kernel, "n_bytes long, n_tokens long")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """``counts`` with ``over_limit``: more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
