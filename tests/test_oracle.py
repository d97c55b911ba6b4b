"""Registered queries against DuckDB on the smallest tables. NOTEWRIGHT_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

from notewright.plans.registry import load
from notewright.sources.corpus import TABLES

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "A27", "A36", "A37", "B04", "B08", "B09", "B10", "B14", "C04", "C08", "C09", "D02", "D06", "D11", "D12", "E01", "E10",
    "E14", "G01", "G08", "J05", "J10", "M05", "M08", "P07", "P19", "R04", "R05", "S08", "S10", "S16", "V02", "V06", "V07",
    "W01", "W02", "W04",
]
QUERIES, ORACLES = load()
KEYS = sorted(ORACLES) if os.environ.get("NOTEWRIGHT_ALL") else CHOSEN


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("key", KEYS)
def test_same_rows_as_sql(spark, duck, key):
    df = QUERIES[key](spark, FOLDER)
    got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[key])
    wanted = _sorted([d[0] for d in result.description], result.fetchall())
    assert got[0] == wanted[0]
    assert got[1] == wanted[1]


def test_every_inventory_row_is_registered():
    sizes = {"S": 17, "P": 31, "A": 38, "C": 9, "J": 10, "W": 15, "R": 18, "M": 8, "E": 15, "D": 12, "B": 15, "V": 10, "G": 9}
    wanted = {f"{letter}{i:02d}" for letter, n in sizes.items() for i in range(1, n + 1)}
    assert set(QUERIES) == wanted
    assert set(ORACLES) <= wanted
