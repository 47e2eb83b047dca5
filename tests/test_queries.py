"""Every family beside its SQL twin. ``LEDGERLENS_ALL=1`` runs the whole catalogue."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module

SF = os.environ.get("LEDGERLENS_SF", "/root/testdata/sf0.001")
CORE = [
    "S01", "S03", "S04", "S14", "S17", "G01", "G03", "G05", "G07", "A01", "A02", "A05", "A07", "C03", "C05", "R03", "R06", "R09", "N05", "N06", "N15",
    "F09", "J09", "W02", "W04", "C17", "U04", "U05", "U10", "M02", "M04", "M05", "M06", "M12", "M13", "M14", "M15", "K04", "A18", "W05", "W06", "W08",
    "L01", "C24", "X03", "X05", "T01", "T02", "T05", "K05", "B04", "B05", "A28", "Z01", "Z04",
]
SQL = entry_module.oracle_sql()
NAMES = [n for n in SQL if os.environ.get("LEDGERLENS_ALL") or n[:3] in CORE]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, message = compare(entry_module.queries()[name](spark, SF), con, SQL[name])
    assert ok, message


def test_entry_runs(spark):
    assert entry_module.entry(spark).columns == ["segment", "c_name", "period", "n_orders", "net_revenue", "discount_rate"]


def test_every_query_has_a_known_name():
    assert len(entry_module.queries()) > 200
    assert set(SQL) <= set(entry_module.queries())
