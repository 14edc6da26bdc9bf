"""Every query with a SQL twin gives its rows."""

from __future__ import annotations

import pytest
from compare import connect, differences

from tallyframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_twin(spark, con, name):
    assert differences(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF) == ""
