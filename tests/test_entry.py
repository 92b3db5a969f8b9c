"""Driver contract."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["EventId", "EventTemplate", "Occurrences"]


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
