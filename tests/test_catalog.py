import pytest
from isovox.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_against_sql(spark, duck, same, name):
    same(catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 198
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
