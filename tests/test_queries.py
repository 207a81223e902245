"""Every registered query of the archive against its SQL."""

import pytest
from conftest import DATA, duck_rows, spark_rows

from pvspark.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = q.queries()[name](spark, DATA)
    columns, rows = duck_rows(duck, q.oracle_sql()[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["time", "value", "min_value", "max_value", "sample_count", "tier"]
    assert set(e.oracle_sql()) <= set(e.queries())
