"""The whole resolver as one plan: normalise, block, rank, score, decide; and from files to files."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..operators import blocking, candidates, decision, features, validate
from ..operators import model as matcher
from ..sources import entities


def resolve(queries: DataFrame, targets: DataFrame, budget: int = 20, threshold: float = config.THRESHOLD, unicode: bool = True, model: PipelineModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) of raw entity tables, one row for each query, by the fast blocks and the rule score, or a trained
    model's score of the 43 features."""
    q, t = X.normalized(queries, unicode), X.normalized(targets, unicode)
    ranked = candidates.production_ranked(blocking.fast_hits(q, t), budget)
    scored = features.rule_scores(ranked, q, t) if model is None else matcher.scored(model, features.base_features(features.with_records(ranked, q, t)))
    spine = queries.select(F.col("entity_id").alias("source1_entity_id"))
    return decision.submission(decision.matches(scored, threshold), spine), decision.submission(ranked, spine, "candidate_entity_ids")


def resolve_files(spark: SparkSession, folder: str, split: str, out: str, **options) -> DataFrame:
    """Resolve <folder>/<split>_source1.tsv against sources 2 and 3, all countries in one plan, into out/matches and
    out/candidates (TSV); returns the audit: problem, n of all that out holds.

    Each call writes a numbered run. A run whose matches are complete is done, and its queries are left out by later calls;
    a run that broke off is written again. options: those of resolve().
    """
    queries = entities.load(spark, folder, split, "source1")
    targets = entities.load(spark, folder, split, "source2").unionByName(entities.load(spark, folder, split, "source3"), allowMissingColumns=True)
    path = lambda kind, n: f"{out}/{kind}/run={n}"
    run = 0
    while _complete(spark, path("matches", run)):
        run += 1
    read = lambda kind, columns, runs: reduce(DataFrame.unionByName, [entities.read_tsv(spark, path(kind, n), columns).select(columns) for n in range(runs)])
    todo = decision.pending(queries, read("matches", entities.MATCH_COLUMNS, run)) if run else queries
    if not run or not todo.isEmpty():
        matches, candidates_ = resolve(todo, targets, **options)
        entities.write_tsv(candidates_, path("candidates", run))
        entities.write_tsv(matches, path("matches", run))
        run += 1
    matches, candidates_ = read("matches", entities.MATCH_COLUMNS, run), read("candidates", entities.CANDIDATE_COLUMNS, run)
    spine = queries.select(F.col("entity_id").alias("source1_entity_id"))
    found = validate.submission_problems(matches, "matched_entity_ids", spine, targets)
    outside = validate.outside_candidates(matches, candidates_).agg(F.lit("match outside the candidates").alias("problem"), F.count("*").alias("n"))
    return found.union(outside)


def _complete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
