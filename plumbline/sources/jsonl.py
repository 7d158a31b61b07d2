"""JSON-lines records: strict reading, aliases and defaults, and writing."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.checks import duplicates, enforce, violations
from plumbline.sources.lines import numbered_lines

CONTEXTS = "array<struct<id:string,text:string>>"
SPANS = "array<struct<start:int,end:int,text:string,label_type:string>>"
#: Canonical name, other name, type.
ALIASES = (("answer", "response", "string"), ("contexts", "context", CONTEXTS), ("gold_spans", "span_label", SPANS))
RESPONSE = f"schema_version string, qid string, source_id string, task_type string, split string, quality string, generator_model string, temperature double, query string, answer string, response string, contexts {CONTEXTS}, context variant, gold_spans {SPANS}, span_label {SPANS}"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with a fixed schema; blank lines are skipped and a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return canonical(read(spark, path, RESPONSE))


def canonical(df: DataFrame) -> DataFrame:
    """Aliases under their canonical names; contexts get ids; ``alias_conflict`` tells where both names differ.

    A context can be a text, a list of texts or of objects.
    """
    if "context" in df.columns and dict(df.dtypes)["context"] == "variant":
        c = F.col("context")
        texts = F.coalesce(F.try_variant_get(c, "$", "array<string>"), F.array(F.try_variant_get(c, "$", "string")))
        objects = F.try_variant_get(c, "$", CONTEXTS)
        plain = F.transform(texts, lambda t, i: F.struct(F.lit(None).cast("string").alias("id"), t.alias("text")))
        df = df.withColumn("context", F.when(c.isNull(), F.lit(None).cast(CONTEXTS)).when(F.schema_of_variant(c).contains("OBJECT"), objects).otherwise(plain))
    both = [(n, o, F.col(n).cast(k), F.col(o).cast(k)) for n, o, k in ALIASES if n in df.columns and o in df.columns]
    conflict = F.lit(False)
    for _, _, a, b in both:
        conflict = conflict | (a.isNotNull() & b.isNotNull() & ~a.eqNullSafe(b))
    df = df.withColumn("alias_conflict", conflict)
    df = df.withColumns({name: F.coalesce(a, b) for name, _, a, b in both})
    df = df.withColumns({n: F.col(o).cast(k) for n, o, k in ALIASES if n not in df.columns and o in df.columns})
    with_id = F.transform("contexts", lambda c, i: F.struct(F.coalesce(c["id"], F.concat(F.lit("passage_"), i + 1)).alias("id"), F.regexp_replace(c["text"], "^(?U)\\s+|(?U)\\s+$", "").alias("text")))
    df = df.withColumn("contexts", with_id)
    return df.drop(*(other for _, other, _ in ALIASES))


def write(df: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A CSV report with a header; refuses to overwrite."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_checked(spark: SparkSession, path: str, schema: str, key: str | None = None, version: str | None = None) -> DataFrame:
    """``read`` with rows required, their schema version, and a key that is there once; anything else raises."""
    rows = read(spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"{path} has no records")
    if version is not None:
        enforce(violations(rows, key or rows.columns[0], {"schema_version": F.col("schema_version") != version}))
    if key is not None:
        enforce(violations(rows, key, {"no_key": F.coalesce(F.col(key).cast("string"), F.lit("")) == ""}).unionByName(duplicates(rows, key)))
    return rows


def prefix(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``."""
    return df.orderBy(order).limit(n)


def write_csv_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file that spreadsheets read as UTF-8; refuses to overwrite."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def _object_text(values: pa.Array) -> pa.Array:
    out = []
    for line in values.to_pylist():
        value = None if line is None else json.loads(line)
        out.append(value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return pa.array(out, pa.string())


def object_text(value: Column) -> Column:
    """A JSON value as text: a string is itself, anything else as Python's ``json.dumps(..., ensure_ascii=False)`` writes it.

    ``value`` is the value's own JSON text, so that the order of keys and the
    kind of numbers are kept; null, also JSON's, is null.
    """
    return F.arrow_udf(_object_text, "string")(value)


def raw_fields(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """``file``, ``line``, ``ordinal`` and the JSON text of each of some fields of every record, as it stands in the file; null where a record lacks it."""
    def run(batches):
        for batch in batches:
            cut = [_raw(line, fields) for line in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array([c.get(f) for c in cut], pa.string()) for f in fields)], names=["file", "line", "ordinal", *fields])

    return numbered_lines(spark, path).mapInArrow(run, "file string, line long, ordinal long, " + ", ".join(f"`{f}` string" for f in fields))


_SPACE = re.compile(r"[ \t\n\r]*")


def _raw(line: str, fields: tuple[str, ...]) -> dict[str, str]:
    """The pieces of a record's line that are the values of ``fields``; of a name that repeats the last counts."""
    decoder, found = json.JSONDecoder(), {}
    at = _SPACE.match(line, 0).end()
    if line[at : at + 1] != "{":
        raise ValueError(f"not an object: {line[:80]}")
    at = _SPACE.match(line, at + 1).end()
    while line[at : at + 1] != "}":
        name, at = decoder.raw_decode(line, at)
        at = _SPACE.match(line, _SPACE.match(line, at).end() + 1).end()
        _, end = decoder.raw_decode(line, at)
        if name in fields:
            found[name] = line[at:end]
        at = _SPACE.match(line, end).end()
        at = _SPACE.match(line, at + 1).end() if line[at : at + 1] == "," else at
    return found


SOURCE = "source_id string, task_type string, source string, prompt string"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source records for ``pairs.filtered_responses``: ``source_info`` has question, passages and, whatever it is in the file, its ``text``; ``line`` is the record's ordinal."""
    names = tuple(c.split()[0] for c in SOURCE.split(", "))
    rows = raw_fields(spark, path, (*names, "source_info"))
    asked = F.from_json(F.col("source_info"), "question string, passages string")
    plain = [F.try_variant_get(F.try_parse_json(c), "$", "string").alias(c) for c in names]
    info = F.struct(asked["question"].alias("question"), asked["passages"].alias("passages"), object_text(F.col("source_info")).alias("text"))
    return rows.select(*plain, info.alias("source_info"), F.col("ordinal").alias("line"))
