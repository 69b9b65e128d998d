import pytest

from lanewise.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(agree, name):
    assert len(agree(QUERIES[name], ORACLE[name]))


def test_fit_gives_a_row_for_each_class(spark):
    from tests.conftest import DATA

    rows = QUERIES["linear_fit"](spark, DATA).collect()
    assert len(rows) == 10 and all(len(r.weights) == 64 for r in rows)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
