"""Every registered query against its DuckDB oracle (the driver's check, at sf0.001)."""

from __future__ import annotations

import pytest

from innsight import registry
from innsight.oracle import compare

SF_SMALL = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, name):
    df = registry.queries()[name](spark, SF_SMALL)
    ok, msg = compare(df, SF_SMALL, ORACLES[name])
    assert ok, msg

