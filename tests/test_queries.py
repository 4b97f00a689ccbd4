import os
import subprocess
import sys

import pytest
from oracle import DATA, connect, expected, result

import __spark_entry__ as entry_points
from larkspan.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert result(entry_points.queries()[name](spark, DATA)) == expected(con, SQL[name])


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    code = "import sys, pkgutil, importlib, larkspan\nfor m in pkgutil.walk_packages(larkspan.__path__, 'larkspan.'):\n  if not m.name.startswith('larkspan.llm'): importlib.import_module(m.name)\nassert not [m for m in sys.modules if m.startswith('larkspan.llm.')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry_points.__file__))
