"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import differences
from leadloom.plans.catalog import load_all

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(load_all()))
def test_query(spark, name):
    assert differences(spark, FOLDER, name) is None


def test_entry_and_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 200
