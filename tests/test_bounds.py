"""What grows with a table must be cut into pieces: batches of texts, rows of pairs, copies of vectors."""

import pytest

from plumbline.operators import ranking, verdicts
from plumbline.operators.claims import split_claims
from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plainly(spark):
    """No adaptive plans and no broadcasts, as for tables that are large."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    was = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "-1")):
        spark.conf.set(n, v)
    yield lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    for n, v in zip(names, was):
        spark.conf.set(n, v)


def test_statements_come_in_small_batches(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(1 << 30))
    split_claims(spark.createDataFrame([(1, "a. b.")], "k int, t string"), "k", "t")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_rules_deal_no_terms(plainly, spark):
    dealt = plainly(catalog.queries()["rule_verdicts"](spark, SF))
    assert dealt and not any("term#" in line or "claim_id#" in line for line in dealt), dealt


def test_rules_on_odd_rows(spark):
    claims = spark.createDataFrame([(1, "a", "red fox not here"), (2, "a", "unable to answer"), (3, "b", "red"), (4, None, "red"), (5, "a", "")], "claim_id int, g string, claim string")
    pool = spark.createDataFrame([("a", 2, "red fox here"), ("a", 1, "red fox here"), ("a", 3, None), (None, 1, "red")], "g string, pos int, text string")
    got = {r.claim_id: (r.pos, r.overlap, r.label) for r in verdicts.rule_verdicts(claims, pool, "g").collect()}
    assert got == {1: (1, 3, "conflict"), 2: (1, 0, "supported"), 3: (None, 0, "unsupported"), 4: (None, 0, "unsupported"), 5: (1, 0, "unsupported")}


def test_costs_and_orders_deal_no_candidate_texts(plainly, spark):
    """A cost is computed before its row is dealt, and only chosen chunks meet their texts."""
    text = lambda name: plainly(catalog.queries()[name](spark, SF))
    assert not any("cost" in line and "text#" in line for line in text("budget_select"))
    dealt = text("order_control")
    assert any("hashpartitioning(chunk_id#" in line for line in dealt), dealt


def test_copies_of_vectors_do_not_grow(spark):
    for total in (10, 4096, 100_000, 720_000, 2_000_000):
        assert -(-total // ranking.dense_block(total)) <= 32
    assert ranking.dense_block(4096) == ranking.DENSE_BLOCK
