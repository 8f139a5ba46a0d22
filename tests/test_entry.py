"""Every registered query against its SQL in DuckDB."""

import sys
from pathlib import Path

import pytest
from conftest import ROOT, TESTDATA

import __spark_entry__ as entry

sys.path.insert(0, str(ROOT / "tools"))
import compare  # noqa: E402

SF_DIR = str(TESTDATA / "sf0.01")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 11


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    if name in entry.oracle_sql():
        assert compare.difference(df.columns, rows, *compare.oracle_rows(duck, entry.oracle_sql()[name])) is None
    else:
        assert rows
