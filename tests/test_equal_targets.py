"""Many equal targets: one row stands for them, and lists, limits and counts are those of all of them."""

import duckdb
import pytest

from kinweave.plans.queries import ORACLES, QUERIES
from kinweave.sources import entities
from tests.test_queries import rows

PART = "/root/testdata/sf0.001/part.parquet"


@pytest.fixture(scope="module")
def equal(tmp_path_factory):
    """Two parts 3,300 times; forty parts six times; some keys twice, with equal and other rows."""
    at = tmp_path_factory.mktemp("equal")
    p = f"(SELECT * REPLACE (p_partkey * 15 AS p_partkey) FROM '{PART}')"
    duckdb.execute(
        f"""COPY (
        SELECT p_partkey + 30001 * i AS p_partkey, * EXCLUDE (p_partkey, i) FROM (SELECT * FROM {p} WHERE p_partkey < 30), range(3300) r(i) UNION ALL
        SELECT p_partkey + 30001 * i AS p_partkey, * EXCLUDE (p_partkey, i) FROM (SELECT * FROM {p} WHERE p_partkey BETWEEN 30 AND 615), range(6) r(i) UNION ALL
        SELECT p_partkey + 30001, * EXCLUDE (p_partkey) FROM {p} WHERE p_partkey BETWEEN 30 AND 60 UNION ALL
        SELECT p_partkey + 30016, * EXCLUDE (p_partkey) FROM {p} WHERE p_partkey BETWEEN 60 AND 90) TO '{at}/part.parquet'"""
    )
    return str(at)


def test_records(spark, equal):
    members = entities.business_target_classes(spark, equal)
    got = {r.representative: r for r in members.groupBy("representative").agg({"entity_id": "count", "n": "max", "r": "max"}).collect()}
    assert all(r["count(entity_id)"] == r["max(n)"] == r["max(r)"] for r in got.values())
    few = entities.business_target_records(spark, equal, 100).collect()
    assert {r.entity_id for r in few} == set(got) and len(few) < 200
    assert all(r.n == got[r.entity_id]["max(n)"] and list(r.ids) == sorted(r.ids) and len(r.ids) == min(r.n, 100) for r in few)
    assert max(r.n for r in few) > 100


@pytest.mark.parametrize("name", ["block_false_rates", "block_investigation", "candidate_stats", "source_separation", "prune_multi_block"])
def test_equal(spark, equal, name):
    df = QUERIES[name](spark, equal)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{equal}/part.parquet'")
    want = c.execute(ORACLES[name])
    got = [tuple(r) for r in df.collect()]
    assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())
