"""Places of many quotes in their sources: each source is read once for all its quotes.

The quotes of a source are dealt to batches of bounded size, a batch becomes one
multi-pattern automaton, and the source's text passes through it once.  So a
text is moved as often as it has batches, not as often as it has quotes, and a
source with very many quotes is searched by many tasks.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quotes of a source that one automaton holds, about.
BATCH = 1000
#: Places in one row that leaves the search.
PLACES = 1 << 16


def search(text: str, quotes: list[str]) -> dict[str, list[int]]:
    """The 0-based places of each quote that occurs, ascending; overlapping ones too."""
    found: dict[str, list[int]] = {}
    automaton = ahocorasick.Automaton()
    for q in quotes:
        automaton.add_word(q, q)
    automaton.make_automaton()
    for end, q in automaton.iter(text):
        found.setdefault(q, []).append(end - len(q) + 1)
    return found


def _found(batches):
    for batch in batches:
        for i, (text, quotes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            for quote, places in search(text, quotes).items():
                for at in range(0, len(places), PLACES):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([quote]), pa.array([np.array(places[at : at + PLACES], np.int32)])], names=["k", "quote", "places"])


def quote_places(quotes: DataFrame, texts: DataFrame, keys: list[str], quote: str = "quote", text: str = "text", size: int = BATCH) -> DataFrame:
    """``keys``, ``quote`` and ``place``: a row for each place of each different quote of a source in that source's text.

    Rows with a null key or text, and empty quotes, have no place.
    """
    asked = quotes.select(*keys, F.col(quote).alias("quote")).where(F.col("quote") != "").distinct()
    many = asked.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("__batches"))
    dealt = asked.join(many, keys).withColumn("__batch", F.pmod(F.xxhash64("quote"), F.col("__batches")))
    sets = dealt.groupBy(*keys, "__batch").agg(F.collect_list("quote").alias("__quotes"))
    told = texts.select(*keys, F.col(text).cast("string").alias("__text")).where("__text is not null").join(sets, keys)
    kinds = ", ".join(f"{k}: {texts.schema[k].dataType.simpleString()}" for k in keys)
    rows = told.select(F.struct(*keys).alias("k"), "__text", "__quotes").mapInArrow(_found, f"k struct<{kinds}>, quote string, places array<int>")
    return rows.select("k.*", "quote", F.explode("places").alias("place"))
