"""Every query of the core against its SQL twin, and those without one for a run with a stable schema."""

import pytest
from compare import same

import __spark_entry__
from veilspan.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(name, spark, duck, data):
    same(catalogue.QUERIES[name](spark, data), duck.execute(catalogue.ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(name, spark, data):
    df = catalogue.QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns) and (df.count() > 0) == (name != "salutation_names")  # nobody is addressed in the feedback


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
