"""Union, ranking and pruning of candidates, and statistics about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config
from .blocking import marked

PAIR = ["source1_entity_id", "candidate_entity_id"]
#: What block_investigation reads of records.
INVESTIGATED = ["house_number", "name_norm", "name_core", "postal_code", "address_norm"]


def _weight(weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col("block")), F.lit(1.0))


def united(hits: DataFrame, weights: dict[str, float], names: list[str] | None = None) -> DataFrame:
    """One row for each pair: source, blocks (sorted), support, strength, top (largest weight), best_block. With names, hits
    are pairs marked by them, and marks stand for both columns of names until named()."""
    if names:
        at = lambda i: F.col("marks").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        heavy = sorted(((weights.get(n, 1.0), i) for i, n in enumerate(names)), reverse=True)
        return hits.select(
            "home", *PAIR, "source", "marks", F.bit_count("marks").cast("long").alias("support"), sum((F.when(at(i), w).otherwise(0.0) for w, i in heavy), F.lit(0.0)).alias("strength"),
            F.coalesce(*[F.when(at(i), w) for w, i in heavy]).alias("top"),
        )
    return (
        hits.withColumn("w", _weight(weights))
        .groupBy(*PAIR, "source")
        .agg(
            F.array_sort(F.collect_set("block")).alias("blocks"), F.count("*").alias("support"), F.sum("w").alias("strength"), F.max("w").alias("top"),
            F.max(F.struct("w", "block"))["block"].alias("best_block"),
        )
    )


def named(pairs: DataFrame, weights: dict[str, float], names: list[str]) -> DataFrame:
    """blocks and best_block in place of marks."""
    heavy = sorted(((weights.get(n, 1.0), n) for n in names), reverse=True)
    best = F.coalesce(*[F.when(F.col("marks").bitwiseAND(F.lit(1 << names.index(n)).cast("long")) != 0, F.lit(n)) for _, n in heavy])
    return pairs.withColumns({"blocks": F.array_sort(marked(names, F.col("marks"))), "best_block": best}).drop("marks")


def for_members(pairs: DataFrame, homes: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of representatives, once for each query they stand for. classes: representative, ids (of queries; several rows may
    share a representative). homes: of the representatives; their rows stay at home, and only the queries' ids are sent there."""
    members = classes.join(homes.withColumnRenamed("source1_entity_id", "representative"), "representative").select(F.col("home").alias("at"), F.array("representative").alias("of"), "ids")
    rest = [c for c in pairs.columns if c not in ("home", "source1_entity_id")]
    lists = pairs.groupBy("home", F.col("source1_entity_id").alias("representative")).agg(F.collect_list(F.struct(*rest)).alias("rows"))
    each = lists.join(members, (F.col("home") == F.col("at")) & F.array_contains("of", F.col("representative")))
    return each.select(F.explode("ids").alias("source1_entity_id"), "rows").select("source1_entity_id", F.inline("rows"))


def ranked(pairs: DataFrame, order: list[str], budget: int, per_source: bool) -> DataFrame:
    """The first budget pairs of each query (and source) by the named columns, all descending, with their rank."""
    w = W.partitionBy(*[c for c in ("home",) if c in pairs.columns], "source1_entity_id", *(["source"] if per_source else [])).orderBy(*[F.desc(c) for c in order])
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= budget)


def base_ranked(hits: DataFrame, budget: int = 200, names: list[str] | None = None) -> DataFrame:
    return ranked(united(hits, config.BASE_WEIGHTS, names), ["support", "strength", "top", "candidate_entity_id"], budget, True)


def extended_ranked(hits: DataFrame, budget: int = 200, names: list[str] | None = None) -> DataFrame:
    return ranked(united(hits, config.RANK_WEIGHTS, names), ["support", "strength", "top", "candidate_entity_id"], budget, True)


def support_ranked(hits: DataFrame, budget: int = 200, names: list[str] | None = None) -> DataFrame:
    return ranked(united(hits, config.RANK_WEIGHTS, names), ["support", "candidate_entity_id"], budget, False)


def production_ranked(hits: DataFrame, budget: int = 20) -> DataFrame:
    return ranked(united(hits, config.RANK_WEIGHTS), ["support", "strength", "candidate_entity_id"], budget, False)


def pruned(hits: DataFrame, policy: str, budget: int, names: list[str] | None = None) -> DataFrame:
    """To a budget over both sources, by priority or by multi_block support."""
    orders = {"priority": ["top", "support", "strength"], "multi_block": ["support", "strength", "top"]}
    return ranked(united(hits, config.BUDGET_WEIGHTS, names), [*orders[policy], "candidate_entity_id"], budget, False)


def first_found(hits: DataFrame, names: list[str], budget: int = 50) -> DataFrame:
    """The first budget pairs of each query and source in the order of blocks and of candidates within a block."""
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    first = hits.groupBy(*PAIR, "source").agg(F.min(F.struct(F.element_at(number, F.col("block")).alias("n"), "place")).alias("at"), F.array_sort(F.collect_set("block")).alias("blocks"))
    w = W.partitionBy("source1_entity_id", "source").orderBy("at", "candidate_entity_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= budget).drop("at")


def written_blocks(pairs: DataFrame) -> DataFrame:
    """blocks as one string."""
    return pairs.withColumn("blocks", F.array_join("blocks", ","))


# The statistics below count marked pairs of representatives (blocking.marked_pairs with truth). spine has a row for each
# representative: source1_entity_id, ids and rows, how many ids and rows of queries it stands for.


def _bit(i: int) -> Column:
    return F.col("marks").bitwiseAND(F.lit(1 << i).cast("long")) != 0


def _found(names: list[str]) -> Column:
    return F.col("marks").bitwiseAND(F.lit((1 << len(names)) - 1).cast("long")) != 0


def _times(n: str, by: str = "ids") -> Column:
    return F.coalesce(F.sum(F.col(n) * F.col(by)), F.lit(0))


def statistics(marks: DataFrame, names: list[str], spine: DataFrame, n_targets: Column | int) -> DataFrame:
    """One row: recall, candidates per query (mean, median, p95, p99, max), reduction, precision, singleton exposure.

    Only distinct pairs count; recall is 1 without any truth.
    """
    true = _bit(len(names))
    per = marks.groupBy("source1_entity_id").agg(F.count_if(_found(names)).alias("n"), F.count_if(_found(names) & true).alias("tp"), F.count_if(true).alias("n_true"))
    per = spine.join(per, "source1_entity_id", "left").na.fill(0)
    total = F.coalesce(F.sum("rows"), F.lit(0))
    sums = lambda c: F.sum(F.col(c) * F.col("rows"))
    return per.agg(
        total.alias("n_queries"), sums("n").alias("n_candidates"), sums("tp").alias("n_found"), sums("n_true").alias("n_true"),
        F.coalesce(F.try_divide(sums("tp"), sums("n_true")), F.lit(1.0)).alias("pair_recall"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true") * F.col("rows"))), F.sum(F.when(F.col("n_true") > 0, F.col("rows")))), F.lit(1.0)).alias("mean_recall"),
        F.try_divide(sums("n"), F.sum("rows")).alias("mean_candidates"),
        *[F.percentile("n", F.lit(p), F.col("rows")).alias(f"{c}_candidates") for p, c in ((0.5, "median"), (0.95, "p95"), (0.99, "p99"))], F.max("n").alias("max_candidates"),
        (1 - F.try_divide(sums("n"), total * n_targets)).alias("reduction"),
        F.coalesce(F.try_divide(sums("tp"), sums("n")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.sum(F.when((F.col("n_true") == 0) & (F.col("n") > 0), F.col("rows"))), F.lit(0)).alias("exposed_singletons"),
    )


def histogram(pairs: DataFrame, spine: DataFrame) -> DataFrame:
    """n, queries, cumulated: how many queries have n candidates. The table has one row for each number."""
    per = spine.select("source1_entity_id").join(pairs.groupBy("source1_entity_id").agg(F.count("*").alias("n")), "source1_entity_id", "left").na.fill(0)
    return per.groupBy("n").agg(F.count("*").alias("queries")).withColumn("cumulated", F.sum("queries").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)))


def audit(pairs: DataFrame, spine: DataFrame, n_targets: Column | int) -> DataFrame:
    """Nearest-rank percentiles from the histogram, and the reduction against all pairs."""
    h = histogram(pairs, spine)
    total = h.agg(F.sum("queries").alias("total"))
    at = lambda p: F.min(F.when(F.col("cumulated") >= p * F.col("total"), F.col("n")))
    return h.crossJoin(F.broadcast(total)).agg(
        F.max("total").alias("n_queries"), F.sum(F.col("n") * F.col("queries")).alias("n_candidates"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"),
        F.max("n").alias("most"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("queries"))), F.lit(0)).alias("without"),
        (1 - F.sum(F.col("n") * F.col("queries")) / (F.max("total") * n_targets)).alias("reduction"),
    )


def _by_block(marks: DataFrame, names: list[str], spine: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """source1_entity_id, block, ids, n_true (over all blocks) and each count of the pairs that satisfy its condition and have the block's mark."""
    per = marks.groupBy("source1_entity_id").agg(
        F.count_if(_bit(len(names))).alias("n_true"), *[F.count_if(_bit(i) & test).alias(f"{c}_{n}") for c, test in counts.items() for i, n in enumerate(names)]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("block"), *[F.col(f"{c}_{n}").alias(c) for c in counts]) for n in names])).alias("x")
    return per.join(spine, "source1_entity_id").select("source1_entity_id", "ids", "n_true", rows).select("source1_entity_id", "ids", "n_true", "x.*")


def incremental(marks: DataFrame, names: list[str], spine: DataFrame, base: str = "name_core") -> DataFrame:
    """What each block adds to the base block: pairs, found truths, truths per added pair."""
    new = ~_bit(names.index(base))
    per = _by_block(marks, names, spine, {"added": new, "gained": new & _bit(len(names))}).where("added > 0")
    return per.groupBy("block").agg(_times("added").alias("added"), _times("gained").alias("gained")).withColumn("gain_rate", F.col("gained") / F.col("added"))


def by_source(marks: DataFrame, names: list[str], spine: DataFrame) -> DataFrame:
    """Pairs, found truths and all truths of each target source."""
    true = _bit(len(names))
    per = marks.groupBy("source1_entity_id", "source").agg(F.count_if(_found(names)).alias("n"), F.count_if(_found(names) & true).alias("tp"), F.count_if(true).alias("n_true")).join(spine, "source1_entity_id")
    found = per.groupBy("source").agg(
        _times("n").alias("n_candidates"), _times("tp").alias("n_found"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("ids"))), F.lit(0)).alias("n_queries"), _times("n_true").alias("n_true")
    )
    return found.where("n_candidates > 0").withColumn("recall", F.coalesce(F.try_divide("n_found", "n_true"), F.lit(1.0)))


def singleton_exposure(marks: DataFrame, names: list[str], spine: DataFrame) -> DataFrame:
    """By block: queries without truth that receive candidates, and how many."""
    true = marks.where(_bit(len(names))).select("source1_entity_id").distinct()
    total = spine.join(true, "source1_entity_id", "left_anti").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("singletons"))
    per = _by_block(marks, names, spine, {"n": F.lit(True)}).where("n_true = 0 and n > 0")
    got = per.groupBy("block").agg(F.sum("ids").alias("receivers"), _times("n").alias("n_candidates"))
    return got.crossJoin(F.broadcast(total)).withColumn("rate", F.col("receivers") / F.col("singletons")).withColumn("per_receiver", F.col("n_candidates") / F.col("receivers"))


def false_rates(marks: DataFrame, names: list[str], spine: DataFrame) -> DataFrame:
    """Of each block: pairs, false pairs and their share."""
    per = _by_block(marks, names, spine, {"n": F.lit(True), "n_false": ~_bit(len(names))}).where("n > 0")
    return per.groupBy("block").agg(_times("n").alias("n"), _times("n_false").alias("n_false")).withColumn("false_rate", F.col("n_false") / F.col("n"))


def recovered(marks: DataFrame, names: list[str], old: str, new_blocks: list[str]) -> DataFrame:
    """Each truth pair that the old block misses, with the new blocks that find it ('' for none)."""
    missed = marks.where(_bit(len(names)) & ~_bit(names.index(old)))
    by = F.array_join(F.array_sort(F.filter(marked(names, F.col("marks")), lambda b: b.isin(new_blocks))), ",")
    return missed.select("home", *PAIR, by.alias("recovered_by"))


def block_investigation(marks: DataFrame, names: list[str], spine: DataFrame, featured: DataFrame, block: str = "house_name") -> DataFrame:
    """One row about one block: true and false pairs, what else agrees in the true ones, those no other block finds, recall by
    source, and singletons that receive candidates. featured: the block's marked pairs with records a and b."""
    hit, ids = _bit(len(names)), F.col("ids")
    other = F.col("marks").bitwiseAND(F.lit((1 << len(names)) - 1 - (1 << names.index(block))).cast("long")) != 0
    same = lambda c: (F.col(f"a.{c}") == F.col(f"b.{c}")) & (F.col(f"a.{c}") != "")
    count = lambda c: F.coalesce(F.sum(F.when(c, ids)), F.lit(0))
    name = (F.col("a.name_norm") == F.col("b.name_norm")) | (F.col("a.name_core") == F.col("b.name_core"))
    row = featured.join(spine, "source1_entity_id").agg(
        count(hit).alias("true_pairs"), count(~hit).alias("false_pairs"), count(hit & same("house_number")).alias("same_house"), count(hit & name).alias("same_name"),
        count(hit & same("postal_code")).alias("same_postal"), count(hit & same("address_norm")).alias("same_address"), count(hit & ~other).alias("only_here"),
        *[count(hit & F.col("candidate_entity_id").startswith(s)).alias(f"true_{s.lower()}") for s in ("S2", "S3")],
    )
    has = lambda i: F.count_if(_bit(i))
    per = marks.groupBy("source1_entity_id").agg(has(len(names)).alias("n_true"), has(names.index(block)).alias("n"), *[F.count_if(hit & F.col("candidate_entity_id").startswith(s)).alias(f"n_{s.lower()}") for s in ("S2", "S3")])
    total = per.join(spine, "source1_entity_id").agg(count((F.col("n_true") == 0) & (F.col("n") > 0)).alias("singletons"), *[_times(f"n_{s}").alias(f"all_{s}") for s in ("s2", "s3")])
    out = row.crossJoin(F.broadcast(total))  # one row each
    return out.withColumn("precision", F.coalesce(F.try_divide(F.col("true_pairs"), F.col("true_pairs") + F.col("false_pairs")), F.lit(0.0))).withColumns(
        {f"recall_{s}": F.coalesce(F.try_divide(F.col(f"true_{s}"), F.col(f"all_{s}")), F.lit(0.0)) for s in ("s2", "s3")}
    )
