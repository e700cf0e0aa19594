import __spark_entry__ as entry


def test_entry_and_oracles(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
