"""Token ids in ORC files.

Documents are dealt by ranges of their id and sorted, so files and the row
groups inside them hold narrow ranges of ids: ORC's row indexes and the Bloom
filter on the id let a lookup skip the rest, and each stripe can be read by a
task of its own.  Ids and counts are integer columns, which ORC writes with its
run-length encodings.  A row knows its file's number (``part``), its place there
(``pos``) and how many ids stand before it there (``offset``); the number of ids
before each part makes that a place in the whole stream.
"""

from __future__ import annotations

import json
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.runtime import bounded_batches, keyed_text, slices
from plumbline.llm.tokencount import library_ids, load_tokenizer

#: ORC writer options.
ROW_INDEX_STRIDE = 1000
STRIPE_BYTES = 16 << 20
BLOOM_FPP = 0.01
#: Code points on whose class (letter, number, white space, other) all versions of Unicode agree.
SETTLED = re.compile("[^\\x00-\u024f\u2010-\u2026\u20ac]")


def rank_table(path: str) -> dict[bytes, int] | None:
    """Bytes -> id of a byte-level BPE file, if merging by rank is proved to give the library's ids; else None.

    The library merges listed pairs, a rank encoder any two neighbours that
    together are a token.  Both do the same if tokens have the order of their
    merges, each is made by one merge of earlier tokens, and each encodes alone
    as itself: when the neighbours x, y make the token t and no lower merge is
    left, what stands there is what t alone comes to before its last merge, so
    (x, y) is the listed pair.
    """
    spec = json.loads(Path(path).read_bytes())
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or spec.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    vocab, pairs = model["vocab"], [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if any(m >= n for m, n in zip(made, made[1:])) or any(max(vocab[a], vocab[b]) >= m for (a, b), m in zip(pairs, made)):
        return None
    alone = load_tokenizer(path).model.tokenize
    if any(len(alone(a + b)) != 1 for a, b in pairs):
        return None
    of = byte_letters()
    return {bytes(of[c] for c in t): i for t, i in vocab.items() if all(c in of for c in t)}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class ByteLevelEncoder:
    """Encodes as the library's byte-level BPE does, by ranks; nothing is kept from text to text.

    Texts with special tokens or with code points outside ``SETTLED`` go to the
    library.
    """

    #: Fixed value: the splitter of byte-level files.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, ranks: dict[bytes, int]):
        self.path = path
        self.ranks = tiktoken.Encoding("byte level", pat_str=self.PIECES, mergeable_ranks=ranks, special_tokens={})
        added = [t["content"] for t in json.loads(Path(path).read_bytes())["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def _is_odd(self, text: str) -> bool:
        return bool(not text.isascii() and SETTLED.search(text) or self.special and self.special.search(text))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where those of each text end."""
        odd = [self._is_odd(t) for t in texts]
        whole = library_ids(load_tokenizer(self.path), [t for o, t in zip(odd, texts) if o]) if any(odd) else iter(())
        out = [np.array(next(whole), "<u4") if o else self.ranks.encode_to_numpy(t, disallowed_special=()) for o, t in zip(odd, texts)]
        return np.concatenate([np.empty(0, "<u4"), *out]).astype("<u4", copy=False), np.cumsum([len(x) for x in out], dtype=np.int64)


class LibraryEncoder:
    """Encodes every text by the library."""

    def __init__(self, path: str):
        self.tok, self.is_piece = load_tokenizer(path), path.endswith(".model")

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.is_piece:
            ids = self.tok.encode(texts, num_threads=1)
        else:
            ids = list(library_ids(self.tok, texts))
        return np.array([i for x in ids for i in x], "<u4"), np.cumsum([len(x) for x in ids], dtype=np.int64)


_ENCODERS: dict[str, ByteLevelEncoder | LibraryEncoder] = {}


def encoder(path: str, ranks: dict[bytes, int] | None):
    """The encoder for a tokenizer file and its ``rank_table``, kept per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path, ranks) if ranks else LibraryEncoder(path)
    return _ENCODERS[path]


def shared_ranks(spark: SparkSession, path: str):
    """The broadcast ``rank_table`` of a tokenizer file (its size is bounded by the vocabulary's); of None where it has none."""
    return spark.sparkContext.broadcast(rank_table(path) if path.endswith(".json") else None)


SCHEMA = "key {id_type}, part int, pos long, offset long, n_tokens int, ids array<int>"


def _encode(tokenizer_path: str, ranks, end_id: int):
    def run(batches):
        part, pos, offset = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer_path, ranks.value)
        for batch in slices(batches):
            flat, ends = encode(pc.fill_null(batch.column(1), "").to_pylist())
            n = len(ends)
            flat = np.insert(flat.view(np.int32), ends, end_id)
            ends = ends + np.arange(1, n + 1)
            sizes = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), pa.array(offset + ends - sizes), pa.array(sizes.astype(np.int32)), lists],
                names=["key", "part", "pos", "offset", "n_tokens", "ids"],
            )
            pos, offset = pos + n, offset + (int(ends[-1]) if n else 0)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every row's whole text and ``end_id`` after each, in ascending order of id.

    A null text counts as empty; null ids come first; rows that repeat an id
    follow each other in the order of their texts, null first.  An empty table
    writes an empty table.
    """
    ranks = shared_ranks(docs.sparkSession, tokenizer_path)
    source = keyed_text(docs, id_col, text_col).repartitionByRange("key").sortWithinPartitions("key", "text")
    schema = SCHEMA.format(id_type=docs.schema[id_col].dataType.simpleString())
    rows = source.mapInArrow(_encode(tokenizer_path, ranks, end_id), schema).withColumnRenamed("key", id_col)
    options = {
        "orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": str(BLOOM_FPP), "orc.create.index": "true",
        "orc.row.index.stride": str(ROW_INDEX_STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd",
    }
    rows.write.options(**options).orc(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """What ``write_ids`` wrote; a filter on ``id_col`` is pushed to stripes and row groups.

    The id's type is that in the files, whatever type it had when written.
    """
    stored = spark.read.orc(path).schema[id_col].dataType.simpleString()
    return spark.read.schema(SCHEMA.format(id_type=stored).replace("key", id_col, 1)).orc(path)


def lookup(spark: SparkSession, path: str, ids: list, id_col: str = "doc_id") -> DataFrame:
    """The rows of a few documents, by row indexes and Bloom filters; ``ids`` are of the type that is stored."""
    return read_ids(spark, path, id_col).where(F.col(id_col).isin(ids))


def _checksums(batches):
    for batch in batches:
        lists = batch.column(3)
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["key", "part", "offset", "n_tokens", "ids_crc32"])


def digest(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``start``, ``n_tokens`` and ``ids_crc32`` of each stored document.

    ``start`` is the number of ids of all documents before it.  Only one row for
    each file's part meets in a single task.
    """
    bounded_batches(stored.sparkSession)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    id_type = stored.schema[id_col].dataType.simpleString()
    rows = stored.select(id_col, "part", "offset", "ids").mapInArrow(_checksums, f"key {id_type}, part int, offset long, n_tokens long, ids_crc32 long")
    rows = rows.join(bases, "part")
    return rows.select(F.col("key").alias(id_col), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
