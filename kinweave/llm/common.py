"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: ASCII white space as the contracts list it: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and executors run on the driver's machine a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kinweave-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kinweave_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of stored() frames that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kinweave_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def python_ready(spark: SparkSession, rows: int = 512) -> None:
    """Before a Python function runs on executors: send them this package, and bound the rows of an Arrow batch, so that
    batches of long texts or sets stay small on both sides."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Stands for a null id inside a plan, so that ids can be joined, compared and sent to Python; null ids come last.
NO_ID = 2**63 - 1


def id_in(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def id_out(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(NO_ID)).alias(col)


def whole_text(col: str | Column = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_key(id_col: str, text_col: str = "text") -> Column:
    """Hash of a row's id and text: rows that share an id, or have none, differ by their text. Equal rows share it."""
    return F.xxhash64(id_in(id_col), whole_text(text_col))


def without(docs: DataFrame, out: DataFrame, key: Column, once: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose key is in out's column __out, all columns as they were; of rows whose key is in
    once's column __once, one stays."""
    kept = docs.join(out, key == out["__out"], "left_anti")
    if once is None:
        return kept
    one = kept.join(once, key == once["__once"], "left_semi").withColumn("__key", key).dropDuplicates(["__key"]).drop("__key")
    return kept.join(once, key == once["__once"], "left_anti").unionByName(one)


def repeated_keys(keys: DataFrame) -> DataFrame:
    """__once: the values of the column key that several rows have."""
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("__once"))
