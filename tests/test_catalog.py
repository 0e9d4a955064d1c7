"""Every catalogue query against its SQL oracle on the smallest tables."""

import os

import pytest
from compare import connect, differences

from contractflow.plans.catalog import catalog
from contractflow.plans.oracles import oracles

SF_DIR = os.environ.get("CONTRACTFLOW_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(catalog()) == set(oracles())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", list(catalog()))
def test_query(spark, con, name):
    assert differences(spark, con, SF_DIR, catalog()[name], oracles()[name]) is None
