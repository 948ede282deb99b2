import __spark_entry__ as e


def test_every_query_is_callable_and_named_alike():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60


def test_entry(spark):
    assert e.entry(spark).count() == 617
