"""Places of lines in files.

A text file is read in splits; within a split lines come in order.  The lines of
each split are counted, those few counts are summed up in the order of files and
splits, and a line's place is the sum before its split and its place in it.  So
nothing is sorted, and no order of tasks matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.places import bounded

SPLIT = ["file", "__block"]


def _in_splits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"))
    return read.withColumn("__id", F.monotonically_increasing_id())


def _sums(rows: DataFrame, number: str, *, within: list[str], name: str) -> DataFrame:
    """For each split what to add to ``number`` to make it a place ``name``, from 0 in each of ``within``."""
    counts = rows.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.min(number).alias("first"))
    before = Window.partitionBy(*within).orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    return counts.select(*SPLIT, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias(name))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``line`` (from 1 in its file, blank lines counted), ``ordinal`` (from 0 over all files in the order of their names, blank lines not counted) and ``value`` of the lines that are not blank."""
    every = _in_splits(spark, path)
    rows = every.where(F.trim("value") != "").withColumn("__no", F.monotonically_increasing_id())
    lines = _sums(every, "__id", within=["file"], name="__line")
    ordinals = _sums(rows, "__no", within=[], name="__ordinal")
    told = rows.join(bounded(lines.join(ordinals, SPLIT)), SPLIT)
    return told.select("file", (F.col("__id") + F.col("__line") + 1).alias("line"), (F.col("__no") + F.col("__ordinal")).alias("ordinal"), "value")


def record(value: Column, schema: str) -> Column:
    """The line as a struct; null where it is none."""
    told = F.from_json(value, F.lit(f"{schema}, _broken string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return F.when(told["_broken"].isNull(), told.dropFields("_broken"))


def numbered_records(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The records of JSON lines with ``file``, ``line`` and ``ordinal``; a line that is none raises with its place."""
    where = F.concat(F.lit("not a record: "), F.col("file"), F.lit(" line "), F.col("line").cast("string"))
    told = numbered_lines(spark, path).withColumn("r", record(F.col("value"), schema))
    return told.select("file", "line", "ordinal", F.coalesce("r", F.raise_error(where).cast(told.schema["r"].dataType)).alias("r")).select("file", "line", "ordinal", "r.*")


def malformed(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """``file``, ``line`` and ``text`` of the lines that are no records."""
    return numbered_lines(spark, path).where(record(F.col("value"), schema).isNull()).select("file", "line", F.col("value").alias("text"))


def first_records(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The first ``n`` records over all files in the order of their names; later files are not read.

    Files are taken in growing numbers until they have ``n`` lines, so the work
    follows ``n`` and not the folder.
    """
    files = sorted(spark.read.text(path).inputFiles())
    taken, have = 0, 0
    while have < n and taken < len(files):
        more = files[taken : 2 * taken + 1]
        have += spark.read.text(more).where(F.trim("value") != "").limit(n - have).count()
        taken += len(more)
    return numbered_records(spark, files[:taken], schema).where(F.col("ordinal") < n) if taken else numbered_records(spark, path, schema).limit(0)


def misaligned(rows: DataFrame, results: DataFrame, columns: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Where ``results`` are not, line by line, the first of ``rows``: ``ordinal`` and ``differs`` (the columns; ``more_results`` where no row is left).

    Both have ``ordinal``, from 0 without gaps.  Null equals null.  Results that
    end early are right: they are a prefix.
    """
    want = rows.select(F.col(ordinal).alias("__o"), F.struct(*columns).alias("__want"))
    both = results.select(ordinal, F.struct(*columns).alias("__got")).join(want, F.col(ordinal) == F.col("__o"), "left")
    each = F.array_compact(F.array(*(F.when(~F.col("__got")[c].eqNullSafe(F.col("__want")[c]), F.lit(c)) for c in columns)))
    told = F.when(F.col("__o").isNull(), F.array(F.lit("more_results"))).otherwise(each)
    return both.select(F.col(ordinal).alias("ordinal"), told.alias("differs")).where(F.size("differs") > 0)


def check_prefix(rows: DataFrame, results: DataFrame, columns: list[str]) -> None:
    """Raise with the first line at which ``results`` part from ``rows``."""
    first = misaligned(rows, results, columns).orderBy("ordinal").first()
    if first:
        raise ValueError(f"line {first.ordinal + 1} differs in {', '.join(first.differs)}")
