import __spark_entry__ as entry
from rulequarry import queries as core


def test_every_oracle_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_mines_rules(spark):
    out = entry.entry(spark)
    assert out.columns == ["display", "support", "confidence", "confidence_exact"]
    assert out.count() > 0
