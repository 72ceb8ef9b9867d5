import pytest

from lodeseek.plans import catalogue
from tests.conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, SMALL).toPandas()
    theirs = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)
