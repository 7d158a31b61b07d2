"""Runs on disk: manifests, their lineage and states, reports, and models' fingerprints.

Paths are Hadoop paths, so all of it works on any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may follow a state.
STATES = {"prepared": ("materialized", "predicted"), "materialized": ("predicted",), "predicted": ("evaluated",), "evaluated": ()}
MODEL_FILES = (".json", ".safetensors", ".model", ".txt")
NOT_MODEL_FILES = ("MODEL_REVISION.txt", "SHA256SUMS.txt")


def run_id(judge: str, now: datetime | None = None) -> str:
    return f"{judge}-{(now or datetime.now(timezone.utc)):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def refuse_existing(spark: SparkSession, *paths: str) -> None:
    """Nothing is written over."""
    for path in paths:
        if exists(spark, path):
            raise FileExistsError(path)


def refuse_collision(outputs: list[str], inputs: list[str]) -> None:
    """No output may be an input, or lie in one or around one."""
    plain = lambda p: p.removeprefix("file:").rstrip("/") + "/"
    for o in map(plain, outputs):
        for i in map(plain, inputs):
            if o.startswith(i) or i.startswith(o):
                raise ValueError(f"output {o} collides with input {i}")


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """One JSON document; an existing one is an error."""
    refuse_existing(spark, path)
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def advance(manifest: dict, state: str) -> dict:
    """The manifest in its next state; any other step is an error."""
    if state not in STATES[manifest["status"]]:
        raise ValueError(f"{manifest['status']} cannot become {state}")
    return manifest | {"status": state}


def check_protocol(run: dict, expected: dict) -> None:
    """Settings of a run that are not what they must be raise."""
    wrong = {k: run.get(k) for k, v in expected.items() if run.get(k) != v}
    if wrong:
        raise ValueError(f"settings differ: {wrong}")


def check_lineage(hashes: dict[str, str], expected: dict[str, str]) -> None:
    """Tables whose content is not what it was raise; names missing on either side too."""
    wrong = sorted(k for k in hashes.keys() | expected.keys() if hashes.get(k) != expected.get(k))
    if wrong:
        raise ValueError(f"content has changed: {wrong}")


def preflight(reference: dict, settings: dict, inputs: dict[str, str], model: str) -> None:
    """A control run may start only beside a complete reference with the same model, settings and inputs."""
    if reference.get("status") != "complete":
        raise ValueError("the reference run is not complete")
    check_protocol(reference["arguments"], settings)
    check_lineage(inputs, {k: v for k, v in reference["inputs"].items() if k in inputs})
    if reference["model_fingerprint"] != model:
        raise ValueError("the model differs from the reference run's")


def file_hash(spark: SparkSession, path: str, any_line_ends: bool = False) -> str:
    """SHA-256 of a file's bytes, or of its text with line feeds only."""
    content = F.col("content")
    if any_line_ends:
        content = F.encode(F.regexp_replace(F.decode(content, "iso-8859-1"), "\r\n?", "\n"), "iso-8859-1")
    return spark.read.format("binaryFile").load(path).select(F.sha2(content, 256)).first()[0]


def model_fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of a model folder's files, by name and content; each file is hashed where it is read."""
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("hash"))
    rows = sorted((r.name, r.hash) for r in files.collect() if r.name.endswith(MODEL_FILES) and r.name not in NOT_MODEL_FILES)  # a handful of names
    names = [n for n, _ in rows]
    if "config.json" not in names or not any(n.endswith(".safetensors") for n in names):
        raise ValueError("a model has a config.json and weights")
    whole = spark.range(1).select(F.sha2(F.lit("".join(f"{n}\0{h}\n" for n, h in rows)), 256)).first()[0]
    return f"local-sha256:{whole}"


def run_manifest(summary: DataFrame, run: str, judge: str, hashes: dict[str, str], **settings) -> dict:
    """The account of a run as a manifest, from the one row of ``run_summary``."""
    row = summary.first().asDict(recursive=True)
    counts = {x["value"]: x["n"] for x in row.pop("label_counts")}
    return {"run_id": run, "judge": judge, "status": "predicted", "hashes": hashes, "label_counts": counts, **row, **settings}


def report_text(rows: DataFrame, keys: list[str], digits: int = 4) -> str:
    """A small long-form report (``keys``, ``value``) as lines of text, for people."""
    told = rows.orderBy(*keys).collect()
    return "".join(f"{' / '.join(str(r[k]) for k in keys)}: {'-' if r['value'] is None else round(r['value'], digits)}\n" for r in told)


def write_suite(spark: SparkSession, path: str, steps: dict) -> dict:
    """Run named steps in turn and keep what became of each; the first that fails ends the suite and is told."""
    refuse_existing(spark, path)
    done: dict[str, str] = {}
    try:
        for name, step in steps.items():
            done[name] = "failed"
            step()
            done[name] = "complete"
    finally:
        status = "complete" if len(done) == len(steps) and set(done.values()) <= {"complete"} else "failed"
        write_manifest(spark, path, {"status": status, "steps": done})
    return {"status": status, "steps": done}
