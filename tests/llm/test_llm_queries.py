import pytest

from lotstack.llm import queries
from tests.compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.01"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(SQL[name], SF)
