"""Each query against its SQL, and queries without SQL for their columns."""

import pytest
from conftest import rows

from quillmark.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    assert rows(got) == rows(duck.execute(SQL[name]).fetchdf())
