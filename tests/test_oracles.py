"""Every query with an oracle against DuckDB, at the smallest scale.

The stage tables that most queries start from are made once; ``assigned_usage``,
``contract_month_features`` and ``ingest_months`` test the way to them.
"""

import pytest

import registry
from registry import ORACLES, QUERIES, core
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module", autouse=True)
def one_stage(spark):
    used = core.dates(spark, SF)
    with pytest.MonkeyPatch.context() as patch:
        for name in ("sources", "cleaning", "usage", "labels", "pooling", "splits", "evaluation"):
            module = getattr(registry, name)
            if hasattr(module, "dates"):
                patch.setattr(module, "dates", lambda spark, sf: used)
        yield


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None
