"""Every resolver query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from kinweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Shares of unions that only add blocks already compared one by one are left to the larger comparison.
NAMES = [n for n in QUERIES if n in ORACLES and not n.startswith("union_") or n in ("union_base_e", "union_extended_h")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", [n for n in NAMES if n in ORACLES])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())
