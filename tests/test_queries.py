"""Registered queries against their SQL on the smallest given tables.

Every query runs; DOCLEDGER_QUICK=1 runs a selection.
"""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from docledger.plans import all_queries

FOLDER = "/root/testdata/sf0.001"
QUICK = ("fil", "joi1_", "joi2", "joi5", "acl1_can", "acl3", "acl5", "acl6_preview_state_retry", "win1", "ext2", "ext3", "rul2", "red1", "red7", "val5", "val9", "loan", "str5_status", "str2")
NAMES = [n for n in all_queries.QUERIES if not os.environ.get("DOCLEDGER_QUICK") or n.startswith(QUICK)]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    text, ok = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, text


def test_every_query_has_sql():
    assert set(all_queries.QUERIES) == set(all_queries.ORACLES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["department", "verdict", "source", "n"] and out.count() > 0
