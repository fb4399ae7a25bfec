import pytest

from quillspark.llm import catalog

from ..compare import SF, same


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.QUERIES.items() if sql])
def test_query_matches_its_sql(spark, name):
    query, sql = catalog.QUERIES[name]
    same(query(spark, SF), sql)
