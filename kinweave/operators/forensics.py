"""Labels, hard negatives, and the reasons of errors: ladders of conditions, the first that holds decides.

Fixed values: the thresholds in the conditions of the categories, ladders and reasons below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import similarity as S
from ..functions import text as X

PAIR = ["source1_entity_id", "candidate_entity_id"]
# Words of shared commercial buildings, and words that any name may have.
COMMERCIAL = ["plaza", "centre", "center", "mall", "tower", "complex", "building", "floor", "suite", "unit", "room", "market"]
GENERIC = ["inc", "corp", "llc", "ltd", "private", "limited", "group", "holdings", "services", "trading", "enterprises"]


def ladder(steps: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.when(*steps[0])
    for test, label in steps[1:]:
        out = out.when(test, label)
    return out.otherwise(otherwise)


def _a(c: str) -> Column:
    return F.col(f"a.{c}")


def _b(c: str) -> Column:
    return F.col(f"b.{c}")


def _same(c: str, filled: bool = True) -> Column:
    test = _a(c) == _b(c)
    return test & (_a(c) != "") if filled else test


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 for truths, 0 otherwise."""
    t = truth.select("source1_entity_id", F.col("target_id").alias("candidate_entity_id")).distinct().withColumn("label", F.lit(1))
    return pairs.join(t, PAIR, "left").na.fill(0, ["label"])


def negative_category() -> Column:
    """Over a, b and support: what makes a false pair hard."""
    lev = lambda c: S.edit_similarity(_a(c), _b(c))
    return ladder(
        [
            (_same("name_norm"), "Same Name"), (_same("name_core"), "Same Core Name"), (_same("address_norm"), "Same Address"),
            (_same("house_number") & (_a("name_core") != _b("name_core")), "Same House Number"), (_same("postal_code") & (_a("name_core") != _b("name_core")), "Same Postal Code"),
            (F.col("support") >= 2, "Multi-Block"), (lev("name_norm") >= 0.75, "High Name Similarity"), (lev("address_norm") >= 0.75, "High Address Similarity"),
        ],
        "Standard Candidate Negative",
    )


def group_split(queries: DataFrame, ratio: float = 0.8) -> DataFrame:
    """source1_entity_id, part: train or valid, the first floor(n * ratio) queries in the order of a hash, all rows of a
    query on one side. The rank is made from counts by hash prefix, so no task orders all queries."""
    ids = queries.select("source1_entity_id").distinct().withColumn("h", F.md5(F.col("source1_entity_id").cast("binary"))).withColumn("p", F.substring("h", 1, 2))
    parts = ids.groupBy("p").agg(F.count("*").alias("n"))
    # 256 rows at most
    before = parts.withColumn("before", F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).withColumn("total", F.sum("n").over(W.partitionBy()))
    placed = ids.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("h"))).join(F.broadcast(before), "p")
    return placed.select("source1_entity_id", F.when(F.col("before") + F.col("r") <= F.floor(F.col("total") * ratio), "train").otherwise("valid").alias("part"))


def sampled(pairs: DataFrame, most: int, salt: str = "") -> DataFrame:
    """All positives and for each query up to most negatives, hard ones first, in the order of a hash. pairs: label, category."""
    hard = (F.col("category") != "Standard Candidate Negative").cast("int")
    order = W.partitionBy("source1_entity_id", "label").orderBy(F.desc("hard"), "h")
    out = pairs.withColumn("hard", hard).withColumn("h", F.md5(F.concat(F.lit(salt), *PAIR).cast("binary"))).withColumn("r", F.row_number().over(order))
    return out.where((F.col("label") == 1) | (F.col("r") <= most)).drop("hard", "h", "r")


def mined_negatives(pairs: DataFrame, truth: DataFrame, most: int | None = None) -> DataFrame:
    """False pairs with the same name or core, and the reason; a report may show the first most of them."""
    t = truth.select("source1_entity_id", F.col("target_id").alias("candidate_entity_id"))
    tests = [
        (_same("name_norm", False), "same_name"), (_same("name_core", False), "same_core"), (_same("house_number"), "same_house"),
        (_same("postal_code"), "same_postal"), (_same("address_norm"), "same_address"),
    ]
    out = pairs.join(t, PAIR, "left_anti").withColumn("reason", ladder(tests, "")).where("reason <> ''").select(*PAIR, "reason")
    return out if most is None else out.orderBy(*PAIR).limit(most)


def false_positive_category() -> Column:
    """Over a and b: the category of a false merge."""
    name_lev, way_lev = S.edit_similarity(_a("name_norm"), _b("name_norm")), S.edit_similarity(_a("address_norm"), _b("address_norm"))
    name_ov, way_ov = S.overlap(_a("name_tokens"), _b("name_tokens")), S.overlap(_a("address_tokens"), _b("address_tokens"))
    house = _same("house_number")
    exact_name, exact_way = _same("name_norm"), _same("address_norm")
    shared = F.lower(F.concat_ws(" ", _a("business_address"), _b("business_address"))).rlike("|".join(COMMERCIAL))
    alias = F.lower(F.concat_ws(" ", _a("business_name"), _b("business_name"))).rlike("dba|t/a")
    raw = lambda r: X.tokens(F.lower(F.coalesce(r("business_name"), F.lit(""))))
    own = lambda r: F.filter(raw(r), lambda t: ~t.isin(GENERIC))
    return ladder(
        [
            ((exact_name | (name_ov >= 0.70)) & (exact_way | (way_ov >= 0.75)), "C"),
            (house & shared & (name_ov < 0.35), "D"),
            ((exact_way | (way_ov >= 0.65) | (house & (way_lev >= 0.60))) & (name_ov < 0.35) & (name_lev < 0.50), "A"),
            ((exact_name | (name_ov >= 0.75) | (name_lev >= 0.85)) & (way_ov < 0.25) & ~house, "B"),
            (alias | ((name_ov >= 0.60) & (F.size(raw(_a)) != F.size(raw(_b)))), "F"),
            ((name_ov >= 0.50) & ((way_ov >= 0.30) | house), "E"),
            ((F.size(own(_a)) > 0) & (F.size(own(_b)) > 0) & ~F.arrays_overlap(own(_a), own(_b)), "G"),
        ],
        "H",
    )


def _reasons(tests: list[tuple[Column, str]], otherwise: str) -> Column:
    found = F.concat_ws(" | ", *[F.when(t, r) for t, r in tests])
    return F.when(found == "", otherwise).otherwise(found)


def miss_reasons() -> Column:
    """Over a and b: all reasons why a truth isn't found."""
    lev = S.edit_similarity(_a("name_norm"), _b("name_norm"))
    first = lambda r: F.coalesce(F.try_element_at(r("name_tokens"), F.lit(1)), F.lit(""))
    return _reasons(
        [
            ((_a("address_norm") == "") | (_b("address_norm") == ""), "address missing"), (lev < 0.40, "alias or other name"), (lev >= 0.70, "high similarity lost"),
            (_same("house_number") & (first(_a) != first(_b)), "same house, other first word"),
            ((X.initials(_a("name_norm")) == X.initials(_b("name_norm"))) & (lev < 0.70), "same initials"),
        ],
        "general tail",
    )


def false_merge_reasons() -> Column:
    return _reasons(
        [
            (_same("name_norm"), "same name"), (_same("name_core"), "same core"), (_same("address_norm"), "same address"),
            (_same("house_number") & (S.edit_similarity(_a("name_norm"), _b("name_norm")) >= 0.70), "same house, similar name"),
        ],
        "general",
    )


def blocking_miss_category() -> Column:
    """Script, missing address, other name, or distortion."""
    lev, ov = S.edit_similarity(_a("name_norm"), _b("name_norm")), S.overlap(_a("name_tokens"), _b("name_tokens"))
    return ladder(
        [(X.script(_b("business_name")) != "Latin", "1 Multilingual"), (F.trim(F.coalesce(_b("business_address"), F.lit(""))) == "", "2 Missing"), ((lev < 0.40) & (ov < 0.30), "4 DBA")],
        "3 OCR",
    )


def misses(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Truth pairs that found doesn't have."""
    return truth.select("source1_entity_id", F.col("target_id").alias("candidate_entity_id")).distinct().join(found.select(*PAIR), PAIR, "left_anti")


def miss_summary(missed: DataFrame) -> DataFrame:
    """Counts of misses (with a, b) by source, country and tenth of name similarity."""
    lev = S.edit_similarity(_a("name_norm"), _b("name_norm"))
    return missed.groupBy(F.substring("candidate_entity_id", 1, 2).alias("source"), _a("country_norm").alias("country"), F.floor(lev * 10).cast("long").alias("tenth")).agg(F.count("*").alias("n"))


def transformations(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with how name and address of a truth differ."""
    names = ladder(
        [
            (F.lower(_a("business_name")) == F.lower(_b("business_name")), "same"), (_a("name_sorted_tokens") == _b("name_sorted_tokens"), "word order"), (_a("name_core") == _b("name_core"), "suffix"),
            (F.concat(_a("business_name"), _b("business_name")).contains("&"), "ampersand"),
        ],
        "spelling",
    )
    ways = ladder(
        [
            (F.lower(_a("business_address")) == F.lower(_b("business_address")), "same"), (_a("address_norm") == _b("address_norm"), "abbreviation"), (F.trim(_b("business_address")) == "", "empty"),
        ],
        "formatting",
    )
    return pairs.select(*PAIR, names.alias("name_change"), ways.alias("address_change"))


def hybrid_sampled(pairs: DataFrame, most: int = 15, each: int = 6, salt: str = "") -> DataFrame:
    """All positives, and of each query's negatives up to each hard ones by embedding (cosine of 0.7 and more), up to each
    hard ones by blocks (two of them, or house_token), and others in the order of a hash until most are reached.

    pairs: label, embedding_hit, cosine, support, blocks. kind tells how a row was chosen.
    """
    hard_embedding = F.col("embedding_hit") & (F.col("cosine") >= 0.70)
    hard_block = (F.col("support") >= 2) | F.array_contains("blocks", "house_token")
    kind = F.when(F.col("label") == 1, "positive").when(hard_embedding, "embedding").when(hard_block, "classical").otherwise("random")
    order = F.when(F.col("kind") == "embedding", -F.col("cosine")).when(F.col("kind") == "classical", -F.col("support").cast("double"))
    rows = pairs.withColumn("kind", kind).withColumn("h", F.md5(F.concat(F.lit(salt), *PAIR).cast("binary")))
    group = W.partitionBy("source1_entity_id", "kind")
    rows = rows.withColumn("r", F.row_number().over(group.orderBy(order, "h")))
    chosen = F.count(F.when(F.col("kind").isin("embedding", "classical") & (F.col("r") <= each), 1)).over(W.partitionBy("source1_entity_id"))
    rows = rows.withColumn("hard", chosen)
    keep = F.when(F.col("kind") == "positive", True).when(F.col("kind") == "random", F.col("r") <= most - F.col("hard")).otherwise(F.col("r") <= each)
    return rows.where(keep).drop("h", "r", "hard")


def miss_kinds(truth: DataFrame, candidates: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truths that aren't predicted, as misses of blocking or of the model."""
    lost = misses(truth, predicted)
    c = candidates.select(*PAIR).distinct().withColumn("c", F.lit(1))
    return lost.join(c, PAIR, "left").select(*PAIR, F.when(F.col("c").isNull(), "A Blocking").otherwise("B Model").alias("kind"))


def recovery(missed: DataFrame, ranks: DataFrame, scored: DataFrame, threshold: float, top: int = 200) -> DataFrame:
    """Each miss of the classical blocks: retrieved by embedding and accepted, retrieved but rejected, or not retrieved.

    ranks: pairs with embedding_rank; scored: pairs with score; pairs without either count as not retrieved, or as score 0.
    """
    rows = missed.select(*PAIR).join(ranks.select(*PAIR, "embedding_rank"), PAIR, "left").join(scored.select(*PAIR, "score"), PAIR, "left")
    steps = [((F.col("embedding_rank") <= top) & (F.coalesce("score", F.lit(0.0)) >= threshold), "A accepted"), (F.col("embedding_rank") <= top, "B rejected")]
    return rows.select(*PAIR, "embedding_rank", ladder(steps, "C not retrieved").alias("status"))
