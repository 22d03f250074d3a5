"""Lists are sent as one string, and the queries that share them have the rows of their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking
from kinweave.plans.queries import ORACLES, QUERIES
from tests.test_queries import rows

PART = "/root/testdata/sf0.001/part.parquet"
NAMES = ["prune_multi_block", "prune_priority", "prune_priority_100", "rank_extended", "rank_support", "recovered_misses", "source_separation", "union_extended_a", "union_extended_c", "union_extended_e"]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    at = tmp_path_factory.mktemp("packed")
    duckdb.execute(f"COPY (SELECT p_partkey + 300 * i AS p_partkey, * EXCLUDE (p_partkey, i) FROM (SELECT * FROM '{PART}' WHERE p_partkey < 60), range(6) r(i)) TO '{at}/part.parquet'")
    return str(at)


def test_lists(spark):
    lists = [["a"], [""], [], ["", ""], ["b", "a", "a"], ["x\u0001y", "z"], ["\u0001"], ["S2-1", "S2-2", ""]]
    df = spark.createDataFrame([(x,) for x in lists], "ids array<string>").select("ids", blocking._packed(F.col("ids")).alias("p")).repartition(3)
    got = df.select("ids", blocking._unpacked(F.col("p")).alias("back"), F.col("p.list").isNotNull().alias("plain")).collect()
    assert len(got) == len(lists) and all(r.back == r.ids for r in got)
    assert {str(r.ids) for r in got if r.plain} == {str(x) for x in lists if not x or any("\u0001" in i for i in x)}


def test_size(spark):
    """As rows that are sent: less than half."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.concat(F.lit("S2-"), (i * 977 + 100_000).cast("string")))
    df = spark.range(1).select(ids.alias("ids"))
    size = lambda d: sum(r.getSizeInBytes() for r in d._jdf.queryExecution().toRdd().collect())
    plain, packed = size(df.repartition(1)), size(df.select(blocking._packed(F.col("ids")).alias("ids")).repartition(1))
    assert 2 * packed < plain


@pytest.mark.parametrize("name", NAMES)
def test_rows(spark, copies, name):
    df = QUERIES[name](spark, copies)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{copies}/part.parquet'")
    want = c.execute(ORACLES[name])
    got = [tuple(r) for r in df.collect()]
    assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())
