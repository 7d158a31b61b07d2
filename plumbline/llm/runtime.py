"""Arrow helpers of the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.functions.arrow import BATCH_BYTES, BATCH_ROWS, bounded_batches  # noqa: F401  the operators take them from here
from plumbline.sources.scratch import scratch, shared_dir, written  # noqa: F401  and these


def release() -> None:
    """Give memory that is free in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return texts.cast(pa.binary()).to_pylist()


#: Rows and bytes of text that a kernel handles at once (one row can be longer).
SLICE_ROWS = 4096
SLICE_BYTES = 3 << 20


def slices(batches: Iterable[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in slices within ``SLICE_ROWS`` and ``SLICE_BYTES`` of the texts in ``column``."""
    _used[0] = False
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = min(start + SLICE_ROWS, max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
            yield batch.slice(start, end - start)
            start = end
        release()
    if not _used[0]:
        forget()


def fields_of(spark: SparkSession, schema: str) -> list[pa.Field]:
    return [pa.field(f.name, f.type) for f in to_arrow_schema(StructType.fromDDL(schema))]


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, as ``key`` and ``text``; other columns cannot clash."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))


def per_slice(df: DataFrame, id_col: str, text_col: str, kernel: Callable, schema: str) -> DataFrame:
    """Run ``kernel(string array) -> columns`` on slices of the texts.

    The result has ``id_col`` and then the columns of ``schema``, row by row.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    fields = fields_of(df.sparkSession, schema)

    def run(batches):
        for part in slices(batches):
            columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(kernel(part.column(1)), fields)]
            columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=pa.schema([part.schema.field(0), *fields]))

    return keyed_text(df, id_col, text_col).mapInArrow(run, f"key {id_type}, {schema}").withColumnRenamed("key", id_col)


def per_text(df: DataFrame, id_col: str, text_col: str, kernel: Callable, schema: str) -> DataFrame:
    """``per_slice`` with a ``kernel(bytes | None) -> tuple`` for each text."""
    return per_slice(df, id_col, text_col, lambda texts: zip(*map(kernel, as_bytes(texts))), schema)


def word_codes(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For lists of strings: a code per string, where each list ends, and the string of each code."""
    coded = lists.flatten().dictionary_encode()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    return coded.indices.to_numpy(zero_copy_only=False), ends, coded.dictionary


def sums_within(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of ``values`` between one end and the next."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return np.diff(total[ends], prepend=0)


_memories: list[Memory] = []
_used = [False]


def forget() -> None:
    """Empty the memories in this worker; operators that need none call it, as the worker may have served another."""
    for m in _memories:
        m.young, m.old = {}, {}
    release()


class Memory:
    """Values of strings met before, in two generations so that frequent strings stay."""

    def __init__(self, learn: Callable[[list[str]], list], generation: int):
        self.learn, self.generation = learn, generation
        self.young: dict = {}
        self.old: dict = {}
        _memories.append(self)

    def __call__(self, strings: list[str]) -> list:
        """The value of each of different ``strings``; those not kept are learnt together."""
        _used[0] = True
        out = list(map(self.young.get, strings))
        if None in out:
            gone = [s for s, x in zip(strings, out) if x is None]
            found = list(map(self.old.get, gone))
            new = [s for s, x in zip(gone, found) if x is None]
            learnt = iter(self.learn(new) if new else [])
            found = [next(learnt) if x is None else x for x in found]
            if len(self.young) + len(gone) > self.generation:
                self.old, self.young = self.young, {}
            self.young.update(zip(gone, found))
            found = iter(found)
            out = [next(found) if x is None else x for x in out]
        return out
