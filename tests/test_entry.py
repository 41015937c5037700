"""The driver contract: entry runs, every query has an oracle or is listed as rows-only."""

from __spark_entry__ import entry, oracle_sql, queries
from shardlens.plans.catalog import NO_ORACLE, QUERIES


def test_entry_runs(spark):
    df = entry(spark)
    row = df.first()
    assert df.columns == ["rows_checked", "empty_text", "empty_token_lists", "duplicate_texts", "no_markers",
                          "exact_length"]
    assert row["rows_checked"] == 200


def test_every_query_has_an_oracle():
    q, o = queries(), oracle_sql()
    assert (set(q) - set(o)) & set(QUERIES) == NO_ORACLE
    assert set(o) <= set(q)
