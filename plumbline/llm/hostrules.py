"""Quality rules of documents and of the hosts they come from.

Each document is held against fixed rules.  Failures are counted by host; a
host's failure rate under each rule is shrunk towards that of all hosts by a
beta prior fitted to the hosts themselves (moments, with the binomial noise of
small hosts taken out), so that a host is judged by its own documents only as
far as it has many.  A host goes if its rate under a rule is, by the posterior,
almost surely above the limit: its shrunk rate less ``SURE`` posterior standard
deviations.  Then it loses all its documents; else a document stands or falls by
the base rules.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.llm.runtime import as_bytes, bounded_batches, forget, per_text, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
MAX_SYMBOLS_PER_WORD = 1.0
MAX_DUP_LINE_SHARE = 0.5
#: A host goes if surely more than this share of its documents fails a rule,
MAX_HOST_RATE = 0.5
#: that is, by so many posterior standard deviations (95 % one-sided, taken as normal).
SURE = 1.645

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """How many words lie in windows of ``size`` words that occur at least twice."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + size - max(i, covered)
            covered = i + size
    return total


def measure(data: bytes | None) -> tuple[int, int, int, int, int, int]:
    if not data:
        return 0, 0, 0, 0, 0, 0
    words = data.split()
    chars = sum(map(len, words))
    if not data.isascii():
        chars = len(b"".join(words).decode())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, sum(map(data.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))), len(lines) - len(set(lines)), repeated_words(words), len(lines)


#: Rules by name; a document fails where the condition holds.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words",
    "dup_lines": f"n_dup_lines > {MAX_DUP_LINE_SHARE} * n_lines",
}
BASE = ("short", "repeats")


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``id_col``, ``host`` and the measures of every row."""
    pair = docs.select(F.struct(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host")).alias("k"), F.col(text_col).alias("t"))
    out = per_text(pair, "k", "t", measure, MEASURES)
    return out.select(F.col("k.id").alias(id_col), F.col("k.host").alias("host"), *(c.split()[0] for c in MEASURES.split(", ")))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """For each host (null is one): documents, and for each rule failures and shrunk rate; ``host_kept``.

    Failures are summed on both sides of the shuffle, so a host with a large
    part of all rows costs no more than another.
    """
    fails = [F.count_if(F.expr(rule)).alias(f"fail_{name}") for name, rule in RULES.items()]
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"), *fails)
    sums = [x for name in RULES for x in (F.sum(f"fail_{name}").alias(f"f_{name}"), F.sum(F.col(f"fail_{name}") * F.col(f"fail_{name}") / F.col("docs")).alias(f"q_{name}"))]
    all_hosts = hosts.agg(F.count("*").alias("hosts"), F.sum("docs").alias("docs"), *sums).first()  # one row
    bad = F.lit(False)
    for name in RULES:
        a, b = beta_prior(all_hosts["hosts"], all_hosts["docs"] or 0, all_hosts[f"f_{name}"] or 0, all_hosts[f"q_{name}"] or 0.0)
        weight = F.col("docs") + F.lit(a + b)
        rate = (F.col(f"fail_{name}") + F.lit(a)) / weight
        hosts = hosts.withColumn(f"rate_{name}", rate)
        bad = bad | (rate - SURE * F.sqrt(rate * (1 - rate) / (weight + 1)) > max_rate)
    return hosts.withColumn("host_kept", ~bad)


def beta_prior(hosts: int, docs: int, fails: int, squares: float) -> tuple[float, float]:
    """Beta parameters by moments; ``squares`` is the sum over hosts of fails ** 2 / docs."""
    if not docs:
        return 0.5, 0.5
    mean = min(max(fails / docs, 0.5 / (docs + 1)), 1 - 0.5 / (docs + 1))
    between = (squares / docs - (fails / docs) ** 2) - mean * (1 - mean) * max(hosts - 1, 0) / docs
    strength = mean * (1 - mean) / between - 1 if between > 0 else 1e6
    strength = min(max(strength, 1.0), 1e6)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``id_col``, the measures, ``base_failed`` and ``kept`` of every row.

    A null or empty text has no words, so it fails; null hosts are one host;
    repeated rows stay and count each; an empty table gives none.  Other columns
    are not read.
    """
    measured = written(measures(docs, id_col, text_col, host_col), "measures")
    verdicts = host_verdicts(measured, max_rate).select(F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("no_host"), "host_kept")
    rows = measured.withColumns({"h": F.coalesce("host", F.lit("")), "no_host": F.col("host").isNull()}).join(verdicts, ["h", "no_host"])
    base = F.expr(" or ".join(RULES[r] for r in BASE))
    return rows.withColumn("base_failed", base).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


@arrow_udf(StructType([StructField(c.split()[0], LongType()) for c in MEASURES.split(", ")]))
def _measured(texts: pa.Array) -> pa.Array:
    columns = list(zip(*map(measure, as_bytes(texts)))) or [[]] * 6
    forget()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Texts are measured once and written with their measures (without the text
    where a base rule fails it), and are not shuffled unless very many hosts are
    bad.  Nulls, repeats and empty tables are as in ``judge``.
    """
    bounded_batches(docs.sparkSession)
    base = F.expr(" or ".join(RULES[r] for r in BASE).replace("n_", "m.n_"))
    rows = docs.select(F.struct("*").alias("doc"), F.col(host_col).cast("string").alias("host"), _measured(F.col(text_col).cast("string")).alias("m"))
    rows = written(rows.select("host", "m", F.when(~base, F.col("doc")).alias("doc")), "measured")
    bad = host_verdicts(rows.select("host", "m.*"), max_rate).where(~F.col("host_kept"))
    bad = written(bad.select(F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("no_host")), "bad-hosts")  # so that its size is known
    rows = rows.where(~base).select("doc", F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("no_host"))
    return rows.join(bad, ["h", "no_host"], "left_anti").select("doc.*")
