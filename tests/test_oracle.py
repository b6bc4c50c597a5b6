"""Every registered query against its SQL oracle on the small tables."""

import pytest

from verification import cases, check

cases.load_all()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check.oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(cases.ORACLES))
def test_query_matches_oracle(spark, sf_dir, connection, name):
    equal, note = check.compare(spark, connection, sf_dir, name)
    assert equal, note


@pytest.mark.parametrize("name", sorted(set(cases.QUERIES) - set(cases.ORACLES)))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert cases.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["survey_year", "main_mode", "share"]
    totals = df.groupBy("survey_year").sum("share").collect()
    assert len(totals) == 2 and all(abs(row[1] - 1) < 1e-9 for row in totals)
