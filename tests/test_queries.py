import pytest

from logweave.plans import queries as Q

from .oracle import compare

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    compare(spark, D, Q.QUERIES[name], Q.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
