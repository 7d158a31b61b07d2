"""Where a truncated input ends, under a real tokenizer.

Each text is encoded once, whatever pairs it is in: kept are how many tokens it
has and where the first ones end.  Which tokens of a pair stay is arithmetic, and
where the last of them ends is then a lookup.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrow import bounded_batches, text_slices

#: Bytes of text that are encoded at once: a token's encoding takes some hundred bytes.
SLICE_BYTES = 1 << 19


@lru_cache(4)
def _encoder(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.no_truncation()
    found.no_padding()
    return found


def _ends(tokenizer_path: str, most: int):
    """From rows (key, text): the key, the text's tokens and the ends of the first ``most``."""
    def run(batches):
        for part in text_slices(batches, 1, SLICE_BYTES):
            tokens, ends = [], []
            for e in _encoder(tokenizer_path).encode_batch([t or "" for t in part.column(1).to_pylist()], add_special_tokens=False):
                tokens.append(len(e))
                ends.append(pa.array([b for _, b in e.offsets[:most]], pa.int32()))
            starts = pa.array(np.r_[0, np.cumsum([len(x) for x in ends])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(starts, pa.concat_arrays(ends))], names=["k", "tokens", "ends"])

    return run


def token_ends(texts: DataFrame, key: str, text: str, tokenizer_path: str, most: int) -> DataFrame:
    """``key``, ``tokens`` (all) and ``ends`` (of the first ``most``, in characters) of each text; a null is empty.

    A worker holds the encodings of ``SLICE_BYTES`` of text (or of one text), however many rows come at once.
    """
    bounded_batches(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_ends(tokenizer_path, most), f"k {kind}, tokens long, ends array<int>").withColumnRenamed("k", key)


def kept(first: Column, second: Column, room: int) -> tuple[Column, Column]:
    """Tokens that stay of two texts if the longer loses first: it gives way down to the shorter, then both to half the room, an odd token to the longer (the second if they tie)."""
    short, long_ = F.least(first, second), F.greatest(first, second)
    half = F.lit(room // 2)
    fits = first + second <= room
    short_kept = F.when(fits | (short <= half), short).otherwise(half)
    long_kept = F.when(fits, long_).otherwise(room - short_kept)
    return F.when(first <= second, short_kept).otherwise(long_kept), F.when(first <= second, long_kept).otherwise(short_kept)


def truncation_places(pairs: DataFrame, documents: DataFrame, claims: DataFrame, tokenizer_path: str, limits: tuple[int, ...] = (512, 2048), specials: int = 2) -> DataFrame:
    """``pair_id``, ``tokens`` and, for each limit, whether it cuts, how many tokens go in and where what is kept of document and claim ends.

    ``pairs`` has pair_id, document_id and claim_id; ``documents`` and ``claims``
    have those ids and text.  An end is 0 where nothing is kept.
    """
    most = max(limits)
    side = lambda df, key, name: token_ends(df, key, "text", tokenizer_path, most).select(F.col(key), F.col("tokens").alias(f"{name}_tokens"), F.col("ends").alias(f"{name}_ends"))
    rows = pairs.join(side(documents, "document_id", "d"), "document_id").join(side(claims, "claim_id", "c"), "claim_id")
    rows = rows.withColumn("tokens", F.col("d_tokens") + F.col("c_tokens") + specials)
    place = lambda ends, n: F.coalesce(F.try_element_at(ends, F.nullif(n.cast("int"), F.lit(0))), F.lit(0))
    told = []
    for limit in limits:
        d, c = kept(F.col("d_tokens"), F.col("c_tokens"), limit - specials)
        told += [(F.col("tokens") > limit).alias(f"truncated_{limit}"), (d + c + specials).alias(f"input_tokens_{limit}"), place(F.col("d_ends"), d).alias(f"document_end_{limit}"), place(F.col("c_ends"), c).alias(f"claim_end_{limit}")]
    return rows.select("pair_id", "tokens", *told)
