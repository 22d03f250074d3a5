"""Thresholds, score gaps and support rules that turn scores into matches, and the files of a submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config
from . import metrics

PAIR = ["source1_entity_id", "candidate_entity_id"]


def matches(scored: DataFrame, threshold: float = config.THRESHOLD, gap: float | None = None) -> DataFrame:
    """Pairs of the threshold and more; with a gap only those no further than it below their query's best."""
    kept = scored.where(F.col("score") >= threshold)
    if gap is None:
        return kept
    best = F.max("score").over(W.partitionBy("source1_entity_id"))
    return kept.withColumn("best", best).where(F.col("best") - F.col("score") <= gap).drop("best")


def supported(scored: DataFrame, least: int, threshold: float = config.THRESHOLD) -> DataFrame:
    return matches(scored.where(F.size("blocks") >= least), threshold)


def house_token_variants(featured: DataFrame, truth: DataFrame) -> DataFrame:
    """Of the pairs that the house_token block found: true and false ones that pass each further test. a: none, b and c: a
    name similarity of 0.25 or 0.35, d: two common address words. featured: a, b, blocks, name_levenshtein_sim."""
    t = truth.select("source1_entity_id", F.col("target_id").alias("candidate_entity_id")).distinct().withColumn("hit", F.lit(1))
    pairs = featured.where(F.array_contains("blocks", "house_token")).join(t, PAIR, "left")
    name = F.col("name_levenshtein_sim")
    tests = {"a": F.lit(True), "b": name >= 0.25, "c": name >= 0.35, "d": F.size(F.array_intersect("a.address_tokens", "b.address_tokens")) >= 2}
    each = pairs.select("hit", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), test.alias("passes")) for v, test in tests.items()])).alias("x"))
    out = each.groupBy("x.variant").agg(F.count(F.when(F.col("x.passes") & F.col("hit").isNotNull(), 1)).alias("true_pairs"), F.count(F.when(F.col("x.passes") & F.col("hit").isNull(), 1)).alias("false_pairs"))
    return out.withColumn("precision", F.coalesce(F.try_divide(F.col("true_pairs"), F.col("true_pairs") + F.col("false_pairs")), F.lit(0.0)))


def sweep(scored: DataFrame, truth: DataFrame, spine: DataFrame, thresholds=None) -> DataFrame:
    """The decision metrics at each threshold. A pair counts once, at the highest threshold it passes; each query sums its
    counts from there down, so no pair is copied."""
    grid = sorted(float(t) for t in (thresholds or config.THRESHOLDS))
    passed = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("score")))
    t = truth.select("source1_entity_id", F.col("target_id").alias("candidate_entity_id")).distinct()
    pairs = scored.groupBy(*PAIR).agg(F.max(passed).alias("passed")).join(t.withColumn("hit", F.lit(1)), PAIR, "left")
    at = [(F.col("passed") > i, F.col("hit") == 1) for i in range(len(grid))]
    found = pairs.groupBy("source1_entity_id").agg(F.array(*[F.struct(F.lit(g).alias("threshold"), F.count(F.when(p, 1)).alias("n_pred"), F.count(F.when(p & hit, 1)).alias("tp")) for g, (p, hit) in zip(grid, at)]).alias("x"))
    none = F.array(*[F.struct(F.lit(g).alias("threshold"), F.lit(0).cast("long").alias("n_pred"), F.lit(0).cast("long").alias("tp")) for g in grid])
    true = t.groupBy("source1_entity_id").agg(F.count("*").alias("n_true"))
    counts = spine.select("source1_entity_id").join(found, "source1_entity_id", "left").join(true, "source1_entity_id", "left")
    each = counts.select(F.coalesce("n_true", F.lit(0)).alias("n_true"), F.explode(F.coalesce("x", none)).alias("x")).select("n_true", "x.*")
    return metrics.decision_metrics_of(each, ["threshold"])


def best_threshold(swept: DataFrame) -> DataFrame:
    return swept.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def submission(pairs: DataFrame, spine: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row for each query: its ids in order, joined by commas, '' without any."""
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_entity_id")), ",").alias(column))
    return spine.select("source1_entity_id").join(lists, "source1_entity_id", "left").na.fill("", [column])


def pending(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries that the output so far doesn't have."""
    return queries.join(done.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_anti")
