"""Registered queries against their SQL on the smallest tables.

Queries that screen everything first repeat the same work; by default ``screen_all`` stands for them
(``RXSPARK_ALL=1`` runs them too, as does ``run_checks.py``).
"""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def chosen(name):
    repeats = " alerts AS (" in ORACLES.get(name, "") and name not in ("screen_all", "history_counts")
    return os.environ.get("RXSPARK_ALL") or not (repeats or name == "alert_full_context")


@pytest.mark.parametrize("name", [n for n in entry.queries() if chosen(n)])
def test_query(spark, con, name):
    query = entry.queries()[name]
    if name in ORACLES:
        assert difference(spark, SF_DIR, name, query, ORACLES[name], con) is None
    else:
        assert query(spark, SF_DIR).count() > 0
