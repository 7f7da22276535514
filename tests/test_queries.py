"""Every core query runs on the smallest tables, and agrees with its SQL there."""

import os

import pytest
from compare import duck, same

from memlode.plans import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.SQL:
        assert same(spark, con, name, catalog.QUERIES[name], catalog.SQL[name], SMALL) == ""
    else:
        catalog.QUERIES[name](spark, SMALL).write.format("noop").mode("overwrite").save()
