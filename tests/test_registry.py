import pytest

from vectrail.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, same_rows, name):
    same_rows(registry.queries()[name](spark, small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["qid", "tier", "skill_id", "match_type", "prob"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
