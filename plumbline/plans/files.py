"""Queries over places in files, digests and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import digests, draws, pairs, truncation
from plumbline.plans.registry import query
from plumbline.session import table
from plumbline.sources import jsonl, lines
from plumbline.sources.scratch import scratch

TURN = ["conv_id", "turn", "role", "text"]
PLACES_SQL = "p as (select conv_id, turn, role, text, row_number() over (order by conv_id nulls first, turn nulls first, role nulls first, text nulls first) - 1 as ordinal from conversations)"
SWAPPED_SQL = "s as (select * replace (case ordinal % 1000 when 0 then ordinal + 1 when 1 then ordinal - 1 else ordinal end as ordinal) from p where ordinal % 5003 <> 77)"


def stored_turns(spark, d):
    """The turns written as several files of JSON lines and read back with their places."""
    path, turns = scratch(spark, "lines"), table(spark, d, "conversations").select(*TURN)
    turns.repartitionByRange(7, *TURN).sortWithinPartitions(*TURN).write.json(path)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema)
    return lines.numbered_records(spark, path, kinds)


def swapped(rows):
    """Results as a run that mixes up two lines of a thousand and leaves some out would give them."""
    other = F.when(F.col("ordinal") % 1000 == 0, F.col("ordinal") + 1).when(F.col("ordinal") % 1000 == 1, F.col("ordinal") - 1).otherwise(F.col("ordinal"))
    return rows.where("ordinal % 5003 <> 77").withColumn("ordinal", other)


@query(f"with {PLACES_SQL} select conv_id, turn, ordinal from p")
def line_places(spark, d):
    return stored_turns(spark, d).select("conv_id", "turn", "ordinal")


@query(f"""with {PLACES_SQL}, {SWAPPED_SQL} select s.ordinal, case when p.ordinal is null then 'more_results' else concat_ws(',', case when s.conv_id is distinct from p.conv_id then 'conv_id' end, case when s.turn is distinct from p.turn then 'turn' end, case when s.role is distinct from p.role then 'role' end) end differs
from s left join p on s.ordinal = p.ordinal where p.ordinal is null or s.conv_id is distinct from p.conv_id or s.turn is distinct from p.turn or s.role is distinct from p.role""")
def aligned_results(spark, d):
    rows = stored_turns(spark, d)
    return lines.misaligned(rows, swapped(rows), ["conv_id", "turn", "role"]).select("ordinal", F.array_join("differs", ",").alias("differs"))


CHANGED_SQL = """n as (select doc_id, source, case when doc_id % 83 = 0 then n_chars + 1 else n_chars end n_chars from documents where doc_id % 97 <> 0 union all select doc_id, source, n_chars from documents where doc_id % 89 = 0 and doc_id % 97 <> 0 union all select -1 - doc_id, source, n_chars from documents where doc_id % 101 = 0),
o as (select doc_id, source, n_chars from documents), e as (select doc_id, source, n_chars, sum(a) a, sum(b) b from (select *, 1 a, 0 b from o union all select *, 0, 1 from n) x group by doc_id, source, n_chars)"""


@query(f"""with {CHANGED_SQL} select doc_id, case when sum(b) = 0 then 'missing' when sum(a) = 0 then 'added' when bool_or(a = 0 or b = 0) then 'changed' else 'doubled' end as change, cast(sum(a) as bigint) n_old, cast(sum(b) as bigint) n_new from e group by doc_id having bool_or(a <> b)""")
def table_changes(spark, d):
    old = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    kept = old.where("doc_id % 97 <> 0")
    new = kept.withColumn("n_chars", F.when(F.col("doc_id") % 83 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    new = new.unionByName(kept.where("doc_id % 89 = 0")).unionByName(old.where("doc_id % 101 = 0").withColumn("doc_id", -1 - F.col("doc_id")))
    return digests.changes(old, new, ["doc_id"], ["source", "n_chars"])


@query(f"""with {PLACES_SQL}, {SWAPPED_SQL.replace("where ordinal % 5003 <> 77", "")} select distinct s.ordinal // 1024 as block from s left join p using (ordinal) where p.ordinal is null or s.conv_id is distinct from p.conv_id or s.turn is distinct from p.turn or s.role is distinct from p.role or s.text is distinct from p.text""")
def prefix_digests(spark, d):
    rows = stored_turns(spark, d)
    other = F.when(F.col("ordinal") % 1000 == 0, F.col("ordinal") + 1).when(F.col("ordinal") % 1000 == 1, F.col("ordinal") - 1).otherwise(F.col("ordinal"))
    return digests.prefix_blocks(rows, rows.withColumn("ordinal", other), "ordinal", TURN)


@query()
def random_draws(spark, d):
    """A conversation's turns scored by the generator of the conversation, in the order of the turns."""
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("low"))
    pool = turns.join(first, "conv_id").withColumn("pos", F.col("turn") - F.col("low"))
    return draws.pool_draws(pool, "conv_id", "pos", 42).select("conv_id", "turn", "score")


@query()
def exact_sample(spark, d):
    """A hundred documents, as a seeded generator takes them of all in the order of their ids."""
    return draws.exact_sample(table(spark, d, "documents").select("doc_id", "source", "lang"), 100, 42, ["doc_id"])


@query()
def truncation_places(spark, d):
    """Where documents, each beside its source's name and its language as the claim, end under two limits."""
    import public_tokenizers

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text", F.concat_ws(" ", "source", "lang").alias("claim_id"))
    claims = docs.select("claim_id", F.col("claim_id").alias("text")).distinct()
    rows = docs.select(F.col("document_id").alias("pair_id"), "document_id", "claim_id")
    return truncation.truncation_places(rows, docs.select("document_id", "text"), claims, public_tokenizers.path("byte_bpe_50k.json"))


@query("""select cast(c_custkey as varchar) qid, 'tell of ' || c_name query, '{"name": "' || c_name || '", "segment": "' || c_mktsegment || '", "orders": [' || coalesce(o.ids, '') || '], "more": {"nation": ' || c_nationkey || ', "é": null, "good": ' || (c_nationkey > 9) || '}}' as source_text
from customer left join (select o_custkey, string_agg(o_orderkey, ', ' order by o_orderkey) ids from orders group by o_custkey) o on o_custkey = c_custkey""")
def object_sources(spark, d):
    """Sources that are objects, written as JSON lines, read back and converted to responses with the object as its text."""
    ids = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    rows = table(spark, d, "customer").join(ids, F.col("c_custkey") == F.col("o_custkey"), "left")
    more = F.struct(F.col("c_nationkey").alias("nation"), F.lit(None).cast("string").alias("é"), (F.col("c_nationkey") > 9).alias("good"))
    info = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("orders"), more.alias("more"))
    path = scratch(spark, "sources")
    rows.select(F.col("c_custkey").cast("string").alias("source_id"), F.lit("Data2txt").alias("task_type"), F.lit("customer").alias("source"), F.concat(F.lit("tell of "), "c_name").alias("prompt"), info.alias("source_info")).write.option("ignoreNullFields", False).json(path)
    said = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("string").alias("source_id"), F.lit("m").alias("model"), F.lit(0.5).alias("temperature"), F.lit("test").alias("split"), F.lit("good").alias("quality"), F.col("c_comment" if "c_comment" in table(spark, d, "customer").columns else "c_name").alias("response"), F.array().cast(f"array<{pairs.SPAN}>").alias("labels"))
    told = pairs.converted(pairs.filtered_responses(said, jsonl.read_sources(spark, path), task_type="Data2txt"))
    return told.select("qid", "query", F.element_at("contexts", 1)["text"].alias("source_text"))
