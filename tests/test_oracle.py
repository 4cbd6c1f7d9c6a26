"""Every registered query against its SQL counterpart on the driver's tables."""

from __future__ import annotations

import os

import pytest
from compare import database, differences

import __spark_entry__ as entry_module
from wellspring.standin import oracle
from wellspring.standin.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_query_of_the_analysis_has_sql():
    assert oracle.queries().keys() == QUERIES.keys()


@pytest.mark.parametrize("name", list(entry_module.oracle_sql()))
def test_query(spark, con, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    assert differences(df, con, entry_module.oracle_sql()[name]) == []
