"""A Merkle manifest of a table, with a proof for every row.

Leaves are ordered within their group and cut into blocks of ``fan_out ** depth``.
A block is one row that holds its leaves as an array, and higher-order functions
collapse it level by level (``sequence`` counts the runs, ``slice`` takes them,
``transform`` hashes them, ``aggregate`` goes up).  The roots of blocks are the
leaves of the next tier, so a group of any size is hashed in many tasks, and a
tier has a thousandth of the rows of the one below.  Everything is SQL functions.

Proofs come down again: what stands above a block is joined to it once, and each
leaf's path is that of its block after its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.runtime import written
from plumbline.operators.places import null_safe, numbered

FAN_OUT, DEPTH = 2, 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"
WHOLE = "__whole"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that no two rows of values read the same: ``-`` for null, else its length in bytes and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def collapse(nodes: Column, fan_out: int) -> Column:
    """The next level: a hash for every ``fan_out`` consecutive nodes, the last run may have fewer."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan_out).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fan_out + 1, fan_out), ""), 256))


def levels(leaves: Column, total: Column, fan_out: int, depth: int) -> Column:
    """All levels of a block: ``depth`` above the leaves if its group has more blocks, else up to the first single node."""
    def up(done, _):
        top = F.element_at(done, -1)
        return F.when((total > fan_out**depth) | (F.size(top) > 1), F.concat(done, F.array(collapse(top, fan_out)))).otherwise(done)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(leaves), up)


def grown(nodes: DataFrame, group: str, fan_out: int = FAN_OUT, depth: int = DEPTH) -> list[DataFrame]:
    """The tiers of blocks over ``nodes`` (``group``, ``place``, ``total``, ``node`` and, at the lowest, ``row``).

    A block has ``group``, ``block``, ``total``, ``items``, ``levels``; the loop
    ends after the logarithm of the largest group to the base of a block's size.
    """
    size, tiers = fan_out**depth, []
    while True:
        item = F.struct("place", "node", *(["row"] if "row" in nodes.columns else []))
        blocks = nodes.groupBy(group, F.floor(F.col("place") / size).alias("block")).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(item)).alias("items"))
        tiers.append(written(blocks.withColumn("levels", levels(F.transform("items", lambda x: x["node"]), F.col("total"), fan_out, depth)), "merkle"))
        more = tiers[-1].where(F.col("total") > size)
        if more.isEmpty():
            return tiers
        nodes = more.select(group, F.col("block").alias("place"), F.ceil(F.col("total") / size).alias("total"), top().alias("node"))


def top() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def roots(tiers: list[DataFrame], group: str, fan_out: int = FAN_OUT, depth: int = DEPTH) -> DataFrame:
    """``group`` and the ``root`` of each group."""
    ended = [t.where(F.col("total") <= fan_out**depth).select(group, top().alias("root")) for t in tiers]
    out = ended[0]
    for t in ended[1:]:
        out = out.unionByName(t)
    return out


def path(i: Column, fan_out: int, depth: int) -> Column:
    """What stands left and right of the node ``i`` of a block at each level below its top."""
    def step(k):
        at = F.floor(i / F.pow(F.lit(fan_out), k)).cast("int")
        run, place = F.slice(F.element_at("levels", k + 1), F.floor(at / fan_out).cast("int") * fan_out + 1, fan_out), at % fan_out
        return F.struct(F.array_join(F.slice(run, 1, place), "").alias("left"), F.array_join(F.slice(run, place + 2, fan_out), "").alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(depth)), 1, F.size("levels") - 1), step)


def with_paths(tiers: list[DataFrame], group: str, above: DataFrame, fan_out: int = FAN_OUT, depth: int = DEPTH) -> DataFrame:
    """The lowest tier with the columns of ``above`` (one row for each group), whose ``above`` goes on from each block's top."""
    told, extra = None, [c for c in above.columns if c not in (group, "above")]
    for k in range(len(tiers) - 1, -1, -1):
        ended = null_safe(tiers[k].where(F.col("total") <= fan_out**depth), above, [group])
        if k == len(tiers) - 1:
            told = ended
        else:
            each = F.transform("items", lambda x, i: F.struct(x["place"].alias("block"), F.concat(path(i, fan_out, depth), "above").alias("above")))
            inner = told.select(group, *extra, F.inline(each))
            told = ended.unionByName(null_safe(tiers[k].where(F.col("total") > fan_out**depth), inner, [group, "block"]))
    return told


def block_roots(tiers: list[DataFrame], group: str) -> DataFrame:
    """What to keep of a manifest: ``tier``, ``group``, ``block`` and the block's ``root``."""
    out = None
    for k, t in enumerate(tiers):
        rows = t.select(F.lit(k).alias("tier"), group, "block", top().alias("root"))
        out = rows if out is None else out.unionByName(rows)
    return out


def changed_blocks(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """``group`` and ``block`` of the lowest blocks of two ``block_roots`` that differ or that one of them lacks: only these rows need be read."""
    low = lambda df, name: df.where("tier = 0").select(group, "block", F.col("root").alias(name))
    both = null_safe(low(old, "a"), low(new, "b"), [group, "block"], "left").where(~F.col("a").eqNullSafe(F.col("b"))).select(group, "block")
    return both.unionByName(null_safe(low(new, "b"), low(old, "a"), [group, "block"], "left_anti").select(group, "block"))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(steps, start, lambda at, s: digest(s["left"], at, s["right"]))


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, fan_out: int = FAN_OUT, depth: int = DEPTH, tamper: dict[str, Column] | None = None) -> DataFrame:
    """``order``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of every row of ``docs``.

    A leaf is the hash of ``columns``; those of a group ascend by ``order``,
    nulls first, and by themselves, so repeated rows have leaves side by side.
    Groups (null is one) ascend too, and their subroots are the leaves of the
    root.  ``tamper`` names columns and what they are changed to after the
    manifest is made: ``folded_root`` is the changed leaf folded with the
    original path, and ``verified`` whether that is the root.  Columns that are
    not named are not read; an empty table gives no rows.
    """
    hashed = lambda changed: digest(*(field((tamper or {}).get(c, F.col(c)) if changed else F.col(c)) for c in columns))
    leaves = docs.select(F.col(group).alias("group"), F.col(order).alias("key"), hashed(False).alias("node"), hashed(True).alias("changed"))
    placed = numbered(leaves, ["key", "node"], ["group"], total="total")
    tiers = grown(placed.select("group", "place", "total", "node", F.struct("key", "changed").alias("row")), "group", fan_out, depth)
    subroots = roots(tiers, "group", fan_out, depth).select("group", F.col("root").alias("node")).withColumn(WHOLE, F.lit(0))
    ordered = numbered(subroots, ["group"], [WHOLE], total="total").select(WHOLE, "place", "total", "node", F.struct("group").alias("row"))
    upper = grown(ordered, WHOLE, fan_out, depth)
    root = roots(upper, WHOLE, fan_out, depth).withColumn("above", F.array().cast(f"array<{STEP}>"))
    heads = with_paths(upper, WHOLE, root, fan_out, depth)
    each = F.transform("items", lambda x, i: F.struct(x["row"]["group"].alias("group"), x["node"].alias("subroot"), F.concat(path(i, fan_out, depth), "above").alias("above")))
    heads = written(heads.select("root", F.inline(each)), "merkle-heads")
    told = with_paths(tiers, "group", heads, fan_out, depth)
    paths = F.transform("items", lambda x, i: F.struct(x["row"]["key"].alias(order), x["node"].alias("leaf"), x["row"]["changed"].alias("changed"), F.concat(path(i, fan_out, depth), "above").alias("steps")))
    rows = F.transform(paths, lambda x: F.struct(
        x[order].alias(order), x["leaf"].alias("leaf"), F.sha2(F.array_join(F.transform(x["steps"], lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"),
        folded(x["changed"], x["steps"]).alias("folded_root"),
    ))
    rows = told.select("subroot", "root", F.inline(rows))
    return rows.select(order, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
