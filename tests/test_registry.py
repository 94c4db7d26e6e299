import __spark_entry__ as entry


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80
    assert entry.entry(spark).count() > 0
