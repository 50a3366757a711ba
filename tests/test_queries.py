import pytest
from compare import connect, differences

from tideway import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows_as_sql(spark, con, name):
    assert not differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])
