"""Many equal records move as few rows: what the whole query writes to shuffles stays small."""

import duckdb
import pytest

from kinweave.plans.queries import ORACLES, QUERIES
from kinweave.sources import entities
from tests.test_queries import rows

PART = "/root/testdata/sf0.001/part.parquet"


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    at = tmp_path_factory.mktemp("moved")
    duckdb.execute(f"COPY (SELECT p_partkey + 300 * i AS p_partkey, * EXCLUDE (p_partkey, i) FROM (SELECT * FROM '{PART}' WHERE p_partkey < 60), range(400) r(i)) TO '{at}/part.parquet'")
    return str(at)


def written(spark, run):
    """Rows and bytes that run writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    total = lambda: (lambda s: [sum(getattr(s.apply(i), k)() for i in range(s.size())) for k in ("shuffleWriteRecords", "shuffleWriteBytes")])(sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    sc.listenerBus().waitUntilEmpty(30_000)
    before = total()
    out = run()
    sc.listenerBus().waitUntilEmpty(30_000)
    return out, [b - a for a, b in zip(before, total())]


def test_moved(spark, copies):
    df, (n, size) = written(spark, lambda: QUERIES["source_separation"](spark, copies).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{copies}/part.parquet'")
    want = c.execute(ORACLES["source_separation"])
    names = [d[0] for d in want.description]
    assert rows(names, [tuple(r[n] for n in names) for r in df]) == rows(names, want.fetchall())
    assert n < 12_000  # the ids alone are 24,000
