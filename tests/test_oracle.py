"""Every registered workload with SQL must equal its DuckDB oracle (sf0.001)."""
import os

import pytest

from kiln.plans.catalog import ORACLE, REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    from tests.oracle_check import duck
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    from tests.oracle_check import compare
    ok, n, _, detail = compare(spark, con, name, REGISTRY[name], ORACLE[name], SF)
    assert ok, detail
