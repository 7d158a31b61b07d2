"""Audit decisions on statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import strip
from plumbline.operators.checks import compared, content_hash, enforce, field_differences, union, violations
from plumbline.operators.verdicts import LABELS
from plumbline.sources.runs import read_manifest, refuse_existing, write_manifest

# Fixed values.
SOURCE_RELATIVE = "(?i)\\b(?:passage\\s*[123]|(?:the|these|this|provided|given|supplied)\\s+passages?|none\\s+of\\s+the\\s+passages|the\\s+source\\s+(?:text|passages?))\\b"
PREFACE = "(?i)^based on the (?:given|provided) passages,?\\s*"
BOILERPLATE = "(?i)^(?:sure[.!]?\\s*$|sure,?\\s+i can help you with that[.!]?\\s*$|i hope\\b|let me know\\b|unable to answer based on|here (?:are|is) (?:the|my) (?:steps|answer)\\b)"
NONCLAIM = "(?i)^(?:\\(?passage\\s*|[123]\\)?)$"
MISSING_REFERENT = "(?i)^(?:this|these|they|it|therefore|however)\\b"


def is_source_relative(claim: Column) -> Column:
    return F.regexp_replace(claim, PREFACE, "").rlike(SOURCE_RELATIVE)


def proposal(claim: Column, reasons: Column) -> tuple[Column, Column]:
    """The proposed action and its flags, sorted and without repeats; white space around a claim does not count."""
    claim = strip(claim)
    nonclaim = claim.rlike(NONCLAIM) | claim.rlike(BOILERPLATE) | claim.endswith(":")
    relative = is_source_relative(claim)
    action = F.when(nonclaim, "exclude_nonclaim").when(relative, "exclude_source_relative").otherwise("include")
    more = F.when(claim.rlike(MISSING_REFERENT), F.array(F.lit("possible_missing_referent"))).otherwise(F.array().cast("array<string>"))
    flags = F.when(nonclaim, F.array(F.lit("nonclaim"))).when(relative, F.array(F.lit("source_relative"))).otherwise(F.array_sort(F.array_distinct(F.concat(reasons, more))))
    return action, flags


def frozen(pairs: DataFrame, decisions: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """The included pairs with the label of an override, else of the decision, else their own."""
    told = decisions.select(key, "action", F.col("gold").alias("decided"))
    changed = overrides.select(key, F.col("action").alias("new_action"), F.col("gold").alias("new_gold"))
    rows = pairs.join(told, key).join(changed, key, "left")
    rows = rows.where(F.coalesce("new_action", "action") == "include")
    return rows.withColumn("gold", F.coalesce("new_gold", "decided", "gold")).drop("action", "decided", "new_action", "new_gold")


def nonclaim_reason(claim: Column) -> Column:
    """Why a statement says nothing that can be checked."""
    low = F.lower(claim)
    starts = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: low.startswith(w))
    holds = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return (
        F.when(claim.startswith("(Passage") | claim.rlike("^\\p{Nd}+\\)$"), "citation_marker").when(starts("sure", "i hope", "let me", "if none of these options"), "conversation")
        .when(holds("unable to answer", "cannot answer", "cannot provide a brief answer"), "refusal").when(claim.endswith(":") | holds("follow these steps"), "heading").otherwise("framing")
    )


def draft(pairs: DataFrame, nonclaims: DataFrame, reviewed: DataFrame, absent: DataFrame) -> DataFrame:
    """The audit draft: for each pair what has been decided, non-claims first, then reviews, then evidence looked for in vain.

    ``nonclaims`` has pair_id; ``reviewed`` pair_id, eligibility, audited and
    decision; ``absent`` pair_id and note.  All else is pending.
    """
    a = nonclaims.select("pair_id", F.lit(True).alias("is_nonclaim"))
    b = reviewed.select("pair_id", F.struct("eligibility", "audited", "decision").alias("r"))
    c = absent.select("pair_id", F.col("note"))
    rows = pairs.join(a, "pair_id", "left").join(b, "pair_id", "left").join(c, "pair_id", "left")
    n, r, m = F.coalesce("is_nonclaim", F.lit(False)), F.col("r").isNotNull(), F.col("note").isNotNull()
    return rows.select(
        "pair_id", "claim", "gold_label", F.when(n, "nonclaim").when(r, F.col("r.eligibility")).when(m, "eligible").alias("eligibility"),
        F.when(n, "not_applicable").when(r, F.col("r.audited")).when(m, "unsupported").alias("audited"),
        F.when(n, "exclude_from_claim_metrics").when(r, F.col("r.decision")).when(m, F.when(F.col("gold_label") == "unsupported", "keep").otherwise("relabel")).alias("decision"),
        F.when(n, nonclaim_reason(F.col("claim"))).when(m & ~r, F.col("note")).alias("reason"), F.when(n | r | m, "reviewed").otherwise("pending").alias("status"),
    )


def draft_violations(pairs: DataFrame, nonclaims: DataFrame, reviewed: DataFrame, absent: DataFrame) -> DataFrame:
    """Decisions on pairs that do not exist, and pairs decided in two of the three ways."""
    every = union([x.select("pair_id", F.lit(name).alias("way")) for x, name in ((nonclaims, "nonclaim"), (reviewed, "reviewed"), (absent, "absent"))])
    unknown = every.join(pairs, "pair_id", "left_anti").select(F.lit("unknown_pair").alias("rule"), F.col("pair_id").cast("string").alias("key"))
    twice = every.groupBy("pair_id").agg(F.count_distinct("way").alias("n")).where("n > 1").select(F.lit("two_decisions").alias("rule"), F.col("pair_id").cast("string").alias("key"))
    return unknown.unionByName(twice)


def draft_decisions(drafted: DataFrame, source_relative: DataFrame, fragments: DataFrame) -> DataFrame:
    """A draft's rows as decisions, by the first that holds: no claim, unresolved, relative to a source, a fragment, else included.

    ``source_relative`` and ``fragments`` are curated pair_ids.  A row that no
    rule covers has no action (``decision_rules`` finds it).
    """
    a, b = (x.select("pair_id", F.lit(True).alias(name)) for x, name in ((source_relative, "is_relative"), (fragments, "is_fragment")))
    rows = drafted.join(a, "pair_id", "left").join(b, "pair_id", "left")
    action = (
        F.when(F.col("eligibility") == "nonclaim", "exclude_nonclaim").when(F.col("audited") == "needs_adjudication", "exclude_unresolved").when(F.col("is_relative"), "exclude_source_relative")
        .when(F.col("is_fragment"), "exclude_context_fragment").when((F.col("eligibility") == "eligible") & F.col("audited").isin(*LABELS), "include")
    )
    return rows.withColumn("action", action).drop("is_relative", "is_fragment")


def decision_record(pairs: DataFrame, action: Column, proposed: Column, reason: Column, flags: Column, provenance: str) -> DataFrame:
    """Decisions as they are kept: the pair's own fields, what is proposed, and an open sign-off."""
    return pairs.select(
        "pair_id", "qid", "source_id", "claim", "claim_start", "claim_end", F.col("gold_label").alias("original_gold_label"), proposed.alias("proposed_gold_label"), action.alias("action"), reason.alias("reason"),
        flags.alias("screening_flags"), F.lit(provenance).alias("decision_provenance"), F.lit(False).alias("signed"), F.lit(None).cast("string").alias("signed_by"), F.lit(None).cast("string").alias("signed_at"),
    )


def challenge(responses: DataFrame, kind: str = "Conflict") -> DataFrame:
    """Responses with a span whose type names ``kind``."""
    return responses.where(F.exists("gold_spans", lambda s: F.contains(s["label_type"], F.lit(kind))))


def count_violations(rows: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """Sets (values of ``by``, also a null) whose rows are not as many as ``expected`` (``by``, ``n``) says.

    A set that only one side has counts none on the other.  Only a count for
    each set is compared; the key is the set with both counts.
    """
    have = rows.groupBy(by).agg(F.count("*").alias("have")).select(by, "have", F.lit(0).cast("long").alias("want"))
    want = expected.select(by, F.lit(0).cast("long").alias("have"), F.coalesce("n", F.lit(0)).cast("long").alias("want"))
    both = have.unionByName(want).groupBy(by).agg(F.sum("have").alias("have"), F.sum("want").alias("want")).where("have <> want")
    told = F.concat(F.coalesce(F.col(by).cast("string"), F.lit("null")), F.lit(": "), "have", F.lit(" of "), "want")
    return both.select(F.lit("count").alias("rule"), told.alias("key"))


def decision_violations(pairs: DataFrame, decisions: DataFrame, signed: bool = False) -> DataFrame:
    """What keeps decisions from being used: pairs left out or decided twice, changed fields, labels, reasons, sign-off."""
    fields = [f for f in ("qid", "source_id", "claim", "claim_start", "claim_end") if f in pairs.columns and f in decisions.columns]
    own = decisions.withColumn("gold_label", F.col("original_gold_label"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "no_label": (F.col("action") == "include") & ~F.coalesce(F.col("proposed_gold_label").isin(*LABELS), F.lit(False)),
        "unknown_action": ~F.coalesce((F.col("action") == "include") | F.col("action").startswith("exclude_"), F.lit(False)), "no_reason": blank("reason"),
    }
    if signed:
        rules["no_signature"] = ~F.coalesce(F.col("signed"), F.lit(False)) | blank("signed_by") | ~F.coalesce(F.col("signed_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))
    return union([compared(own, pairs, "pair_id", [*fields, "gold_label"]), violations(decisions, "pair_id", rules)])


def overlap_violations(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows that two sets share and on which they differ."""
    return field_differences(a, b, key, fields)


def leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys that are in both of two sets that must have none in common."""
    return train.select(key).intersect(test.select(key)).select(F.lit("in_both").alias("rule"), F.col(key).cast("string").alias("key"))


def audited_set(pairs: DataFrame, decisions: DataFrame, version: str, status: str) -> DataFrame:
    """The included pairs with the decided label, and what decided it."""
    kept = decisions.where("action = 'include'").select("pair_id", F.col("proposed_gold_label").alias("decided"))
    rows = pairs.join(kept, "pair_id").withColumn("gold_label", F.col("decided")).drop("decided")
    return rows.withColumns({"gold_projection_version": F.lit(f"{version}_{status}"), "audit_decision_version": F.lit(version), "audit_status": F.lit(status)})


def set_summary(selected: DataFrame, decisions: DataFrame) -> DataFrame:
    """``part``, ``name``, ``n``: what a set's manifest counts."""
    count = lambda df, c, part: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    return count(selected, "gold_label", "label").unionByName(count(decisions.where("action <> 'include'"), "action", "excluded"))


def write_set(spark, pairs: DataFrame, decisions: DataFrame, path: str, version: str, signed: bool = False) -> dict:
    """Check and write an audited set below ``path``, which must not exist: pairs, decisions, selection and manifest."""
    enforce(decision_violations(pairs, decisions, signed))
    status = "signed_final" if signed else "provisional"
    selected = audited_set(pairs, decisions, version, status)
    if selected.isEmpty():
        raise ValueError("no pair is included")
    refuse_existing(spark, path)
    parts = {"original_pairs": pairs, "decisions": decisions, "pairs": selected}
    for name, rows in parts.items():
        rows.write.parquet(f"{path}/{name}")
    stored = {name: spark.read.parquet(f"{path}/{name}") for name in parts}
    manifest = {"version": version, "status": status, "hashes": {name: content_hash(df, "pair_id") for name, df in stored.items()}, "counts": {f"{r.part}.{r.name}": r.n for r in set_summary(stored["pairs"], stored["decisions"]).collect()}}
    write_manifest(spark, f"{path}/manifest", manifest)
    return manifest


def finalized(spark, path: str, target: str, decisions: DataFrame) -> dict:
    """A provisional set at ``path`` with signed decisions, written to ``target``; its pairs must be as they were."""
    manifest = read_manifest(spark, f"{path}/manifest")
    pairs = spark.read.parquet(f"{path}/original_pairs")
    if content_hash(pairs, "pair_id") != manifest["hashes"]["original_pairs"]:
        raise ValueError(f"the pairs at {path} have changed")
    return write_set(spark, pairs, decisions, target, manifest["version"], signed=True)
