"""Every registered query against its oracle SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tools import check

SF = "/root/testdata/sf0.001"
#: Hundreds of jobs each; their parts are tested in test_parallel_models and test_sources_models.
SLOW = {"train_boosted", "leave_one_match_out", "final_run"}
KEYS = sorted(set(contract.oracle_sql()) - SLOW)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    result = check.compare(spark, con, SF, key)
    assert result.startswith("ok"), result


def test_contract_is_consistent():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 165
