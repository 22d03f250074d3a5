"""Exact retrieval by inner product over unit vectors, and its evaluation.

Queries are cut into blocks of BLOCK vectors, broadcast one by one. One pass over the targets multiplies each batch of
TARGETS vectors by all blocks in turn and keeps the best k of each query, and only these k are shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ship_package

#: Queries of a broadcast block, and targets multiplied by it at a time: their scores take 32 MB.
BLOCK, TARGETS = 2_000, 2_000


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score descending, then id."""
    if scores.shape[1] > k:
        # everything that ties with the k-th score stays until ids decide
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        width = int((scores >= least[:, None]).sum(1).max())
        at = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores))[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _best(blocks, k: int):
    def run(batches):
        best: list = [None] * len(blocks)
        for pdf in batches:
            for i in range(0, len(pdf), TARGETS):
                targets = pdf["target_id"].to_numpy()[i : i + TARGETS]
                matrix = np.stack(pdf["v"].iloc[i : i + TARGETS].to_numpy()).astype(np.float64).T
                for n, shared in enumerate(blocks):
                    queries, vectors = shared.value
                    scores = np.round(vectors @ matrix, 9)
                    scores[queries[:, None] == targets] = -np.inf
                    found = _best_of(scores, np.broadcast_to(targets, scores.shape), k)
                    if best[n] is not None:
                        found = _best_of(*(np.concatenate(x, 1) for x in zip(best[n], found)), k)
                    best[n] = found
        for n, found in enumerate(best):
            if found is not None:
                scores, ids = found
                there = ~np.isneginf(scores)
                yield pd.DataFrame({"query_id": np.broadcast_to(blocks[n].value[0][:, None], ids.shape)[there], "target_id": ids[there], "score": scores[there]})

    return run


def top_k(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """query_id, target_id, score, rank: the k targets of the largest inner product, ties by id; a query is not among its
    own targets. queries and targets: id, v."""
    spark = queries.sparkSession
    ship_package(spark)
    blocks = max(1, -(-queries.count() // BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    shared = []
    for i in range(blocks):
        rows = dealt.where(F.col("block") == i).orderBy("id").select("id", "v").toPandas()  # about BLOCK vectors
        if len(rows):
            shared.append(spark.sparkContext.broadcast((rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(np.float64))))
    found = targets.select(F.col("id").alias("target_id"), "v").mapInPandas(_best(shared, k), "query_id long, target_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "target_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merged(*results: DataFrame, k: int) -> DataFrame:
    """The best k of several top_k() results together, ranked anew."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "target_id")
    return reduce(DataFrame.unionByName, results).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_of(pairs: DataFrame, results: DataFrame, absent: int = 999) -> DataFrame:
    """pairs (query_id, target_id) with their rank in results, or absent."""
    return pairs.join(results.select("query_id", "target_id", "rank"), ["query_id", "target_id"], "left").na.fill(absent, ["rank"])


def recall_at(results: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """k, n_relevant, n_found, recall over pairs (query_id, target_id) that are relevant."""
    found = relevant.join(results.select("query_id", "target_id", "rank"), ["query_id", "target_id"], "left")
    counted = found.agg(F.count("*").alias("n_relevant"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"at_{k}") for k in ks])
    rows = counted.select("n_relevant", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"at_{k}").alias("n_found")) for k in ks])).alias("x")).select("x.k", "n_relevant", "x.n_found")
    return rows.withColumn("recall", F.coalesce(F.try_divide("n_found", "n_relevant"), F.lit(1.0)))


def hybrid(classical: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Classical pairs (query_id, target_id, blocks) and the dense ones up to rank k in one list, with all evidence."""
    dense = results.where(F.col("rank") <= k).select("query_id", "target_id", F.col("rank").alias("embedding_rank"))
    both = classical.join(dense, ["query_id", "target_id"], "full_outer")
    return both.select("query_id", "target_id", F.coalesce("blocks", F.array(F.lit("embedding"))).alias("blocks"), "embedding_rank", F.col("embedding_rank").isNotNull().alias("embedding_hit"))


def hard_negatives(results: DataFrame, relevant: DataFrame, top: int = 25, least: float = 0.7) -> DataFrame:
    """Pairs within the top ranks and of the least score that aren't relevant."""
    return results.where((F.col("rank") <= top) & (F.col("score") >= least)).join(relevant, ["query_id", "target_id"], "left_anti")


def recall_by_category(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """category, k, n, first_recall, second_recall, union_recall of pairs with a category and ranks in two rankings."""
    grid = F.explode(F.array(*map(F.lit, ks))).alias("k")
    rows = ranks.select("category", "first_rank", "second_rank", grid)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    first, second = F.col("first_rank") <= F.col("k"), F.col("second_rank") <= F.col("k")
    return rows.groupBy("category", "k").agg(F.count("*").alias("n"), share(first).alias("first_recall"), share(second).alias("second_recall"), share(F.coalesce(first, F.lit(False)) | F.coalesce(second, F.lit(False))).alias("union_recall"))


def encoded(df: DataFrame, text: str, size: int = 256, grams: int = 3) -> DataFrame:
    """df with v, a unit vector of hashed character n-grams: a stand-in, without a trained encoder, for sentence vectors."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - grams + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(grams)))
    counted = HashingTF(numFeatures=size, inputCol="__g", outputCol="__tf").transform(df.withColumn("__g", pieces))
    unit = Normalizer(inputCol="__tf", outputCol="__unit").transform(counted)
    return unit.withColumn("v", vector_to_array("__unit")).drop("__g", "__tf", "__unit")
