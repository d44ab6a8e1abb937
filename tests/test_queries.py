"""Queries against their SQL on the small tables, and the driver's contract."""

import math
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from priorframe.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()
SAMPLE = ["W01", "W03", "W10", "W12", "W16", "W20", "J03", "J05", "J07", "J08", "J15", "J19", "U10", "U12", "A11", "A12", "A18", "A23", "F04", "F17", "T04", "T08", "M09", "M11", "M13", "M14", "V01", "V06", "S10", "S18", "X05", "X06", "X08", "L01", "L03", "F06", "C01", "C02", "C03", "C05", "C08", "C09", "C11", "C12", "R01", "R05", "R06", "X02", "X03", "X07", "W21", "W22", "M08", "M12", "M18", "M29", "L07", "V19", "V21", "V22", "S12", "S14", "S16", "S17", "C04", "C06", "T03", "T07"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_sql(spark, duck, sf, key):
    df = QUERIES[key](spark, sf)
    columns = sorted(df.columns)
    rows = duck.sql(ORACLES[key])
    places = [rows.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in places) for r in rows.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want and len(rows.columns) == len(columns)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert len(QUERIES) >= 240


def test_entry_works_without_the_llm_parts(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("priorframe.llm")] + ["priorframe.llm", "priorframe.llm.queries"]:
        monkeypatch.setitem(sys.modules, name, None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


def test_nothing_outside_imports_the_llm_parts():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "priorframe"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
