"""Every query against its SQL, or its invariants where SQL cannot say it."""

import pytest
from compare import differ

from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    assert not differ(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)


def test_chunks_stay_within_the_limit(spark):
    rows = catalog.queries()["chunk_pack"](spark, SF).collect()
    assert rows and all(r.token_count <= 128 and r.start < r.end for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
