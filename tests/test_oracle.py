import pytest
from conftest import compared

from tidewell.plans import catalog


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_agrees_with_sql(spark, name):
    got, want = compared(name, spark)
    assert got == want


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["bucket", "series", "event_count"]
    assert entry.entry(spark).count() > 0
