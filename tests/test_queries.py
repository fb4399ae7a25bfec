import pytest

from quillspark.plans import catalog

from .compare import SF, same


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_its_sql(spark, name):
    query, sql = catalog.QUERIES[name]
    same(query(spark, SF), sql)


def test_entry_imports_and_names():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
