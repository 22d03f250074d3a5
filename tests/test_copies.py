"""Many equal records: they are asked once, and every one of them gets the rows."""

import duckdb
import pytest

from kinweave.plans.queries import ORACLES, QUERIES
from kinweave.sources import entities
from tests.test_queries import rows

PART = "/root/testdata/sf0.001/part.parquet"


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    at = tmp_path_factory.mktemp("copies")
    duckdb.execute(f"COPY (SELECT p_partkey + 300 * i AS p_partkey, * EXCLUDE (p_partkey, i) FROM (SELECT * FROM '{PART}' WHERE p_partkey < 60), range(6) r(i)) TO '{at}/part.parquet'")
    return str(at)


def test_classes(spark, copies):
    c = entities.business_classes(spark, copies).collect()
    assert len(c) == len({r.source1_entity_id for r in c}) == 120
    assert len({r.representative for r in c}) <= 20
    assert all(r.representative <= r.source1_entity_id and r.rows == 1 for r in c)


@pytest.mark.parametrize("name", ["candidate_stats", "singleton_exposure", "rank_base", "block_char_3gram_k10"])
def test_copies(spark, copies, name):
    df = QUERIES[name](spark, copies)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{copies}/part.parquet'")
    want = c.execute(ORACLES[name])
    got = [tuple(r) for r in df.collect()]
    assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())
