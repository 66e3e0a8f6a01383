import pytest

from ledgerline.plans import catalog
from tests.conftest import SF
from tests.oracle import oracle, rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(oracle(SF, catalog.ORACLE_SQL[name]))
    else:
        assert len(got.columns)
