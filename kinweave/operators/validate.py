"""Checks of submissions, and profiles of source tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select("source1_entity_id", F.explode(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")).alias("id"))


def submission_problems(df: DataFrame, column: str, spine: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """problem, n: repeated queries, repeated ids in a list, ids of source 1, ids of unknown prefix, unknown ids, missing and
    surplus queries. A problem that doesn't occur has n = 0."""
    ids, keys = _ids(df, column), df.select("source1_entity_id")
    want = spine.select("source1_entity_id").distinct()
    count = lambda name, x: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    checks = [
        count("duplicate query", keys.groupBy("source1_entity_id").count().where("count > 1")),
        count("duplicate id in a list", ids.groupBy("source1_entity_id", "id").count().where("count > 1")),
        count("source 1 id", ids.where(F.col("id").startswith("S1-"))),
        count("unknown prefix", ids.where(~F.col("id").rlike("^S[123]-"))),
        count("missing query", want.join(keys, "source1_entity_id", "left_anti")),
        count("surplus query", keys.distinct().join(want, "source1_entity_id", "left_anti")),
    ]
    if targets is not None:
        checks.append(count("unknown id", ids.join(targets.select(F.col("entity_id").alias("id")), "id", "left_anti")))
    return reduce(DataFrame.union, checks)


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched ids that aren't among the query's candidates."""
    return _ids(matches, "matched_entity_ids").join(_ids(candidates, "candidate_entity_ids"), ["source1_entity_id", "id"], "left_anti")


def profile(df: DataFrame) -> DataFrame:
    """One row for each source: rows, ids, repeated ids, empty fields, distinct values and lengths."""
    name, address = F.length("business_name"), F.length("business_address")
    empty = lambda c: F.count(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", 1))
    return df.groupBy(F.substring("entity_id", 1, 2).alias("source")).agg(
        F.count("*").alias("n"), F.countDistinct("entity_id").alias("ids"), (F.count("*") - F.countDistinct("entity_id")).alias("repeated_ids"),
        empty("business_name").alias("empty_names"), empty("business_address").alias("empty_addresses"), empty("country").alias("empty_countries"),
        F.countDistinct("business_name").alias("names"), F.countDistinct("business_address").alias("addresses"),
        F.min(name).alias("name_min"), F.max(name).alias("name_max"), F.avg(name).alias("name_mean"), F.percentile(name, F.lit(0.5)).alias("name_median"),
        F.min(address).alias("address_min"), F.max(address).alias("address_max"), F.avg(address).alias("address_mean"), F.percentile(address, F.lit(0.5)).alias("address_median"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def normalization_stats(normed: DataFrame) -> DataFrame:
    """One row: how many names and addresses normalisation changed, stripped, emptied or read a part from."""
    count = lambda c: F.count(F.when(c, 1))
    return normed.agg(
        F.count("*").alias("n"), count(F.col("name_norm") != F.col("business_name")).alias("names_changed"), count(F.col("name_core") != F.col("name_norm")).alias("suffixes_stripped"),
        count((F.col("name_norm") == "") & (F.col("business_name") != "")).alias("names_emptied"), count(F.col("address_norm") != F.col("business_address")).alias("addresses_changed"),
        count(F.col("postal_code") != "").alias("postal_codes"), count(F.col("house_number") != "").alias("house_numbers"), count(F.col("address_number_tokens") != "").alias("with_numbers"),
    )


def file_problems(spark, path: str, header: list[str]) -> DataFrame:
    """problem, n for a submission file read as plain lines: a wrong header, a comma-separated header, lines that don't have
    as many fields as the header."""
    lines = spark.read.text(path)
    tabbed, commas = "\t".join(header), ",".join(header)
    is_header = F.col("value") == tabbed
    one = lambda name, n: F.struct(F.lit(name).alias("problem"), n.cast("long").alias("n"))
    row = lines.agg(
        (F.count(F.when(is_header, 1)) == 0).cast("long").alias("no_header"), F.count(F.when(F.col("value") == commas, 1)).alias("comma"),
        F.count(F.when(~is_header & (F.col("value") != commas) & (F.size(F.split("value", "\t")) != len(header)), 1)).alias("malformed"),
    )
    return row.select(F.explode(F.array(one("header missing", F.col("no_header")), one("comma-separated header", F.col("comma")), one("malformed line", F.col("malformed")))).alias("x")).select("x.*")
