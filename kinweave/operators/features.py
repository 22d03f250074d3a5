"""Features of candidate pairs: 43 base features, targeted ones, and those of the hybrid with embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import similarity as S
from ..functions import text as X
from ..session import ship_package

#: The normalised columns that features read.
RECORD = ["name_norm", "name_core", "name_sorted_tokens", "name_char_3gram", "address_norm", "postal_code", "house_number", "name_tokens", "address_tokens", "country_norm", "business_name", "business_address"]


def with_records(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with both records as structs a and b; ids without a record keep nulls inside."""
    a = queries.select(F.col("entity_id").alias("source1_entity_id"), F.struct(*RECORD).alias("a"))
    b = targets.select(F.col("entity_id").alias("candidate_entity_id"), F.struct(*RECORD).alias("b"))
    return pairs.join(a, "source1_entity_id", "left").join(b, "candidate_entity_id", "left")


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def _same(name: str) -> Column:
    return _flag((F.col(f"a.{name}") == F.col(f"b.{name}")) & (F.col(f"a.{name}") != ""))


def base_features(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, blocks, rank) with the 43 features, in their order."""
    ship_package(pairs.sparkSession)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    missing = (a("address_norm") == "") | (b("address_norm") == "")
    unless = lambda x: F.when(missing, 0.0).otherwise(x)
    first = lambda r, i: F.try_element_at(r("name_tokens"), F.lit(i))
    length = F.length
    numbers = lambda r: F.regexp_extract_all(r("address_norm"), F.lit(r"(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])"), F.lit(0))
    longer = F.greatest(length(a("name_norm")), length(b("name_norm")))
    hit = lambda n: _flag(F.array_contains("blocks", n))
    strength = F.create_map(*[F.lit(x) for kv in config.BASE_WEIGHTS.items() for x in kv])
    own = {
        "exact_name_match": _same("name_norm"),
        "exact_name_core_match": _same("name_core"),
        "name_jaro_winkler": S.jaro_winkler(a("name_norm"), b("name_norm")),
        "name_levenshtein_sim": S.edit_similarity(a("name_norm"), b("name_norm")),
        "name_token_jaccard": S.jaccard(a("name_tokens"), b("name_tokens")),
        "name_token_overlap": S.overlap(a("name_tokens"), b("name_tokens")),
        "name_sorted_token_sim": S.edit_similarity(a("name_sorted_tokens"), b("name_sorted_tokens")),
        "name_char_3gram_jaccard": S.jaccard(X.tokens(a("name_char_3gram")), X.tokens(b("name_char_3gram"))),
        "name_len_diff": F.abs(length(a("name_norm")) - length(b("name_norm"))).cast("double"),
        "name_len_ratio": F.when(longer == 0, 1.0).otherwise(F.least(length(a("name_norm")), length(b("name_norm"))) / longer),
        "name_token_count_diff": F.abs(F.size(a("name_tokens")) - F.size(b("name_tokens"))).cast("double"),
        "first_token_match": _flag(first(a, 1) == first(b, 1)),
        "last_token_match": _flag(first(a, -1) == first(b, -1)),
        "exact_address_match": _same("address_norm"),
        "address_levenshtein_sim": unless(S.edit_similarity(a("address_norm"), b("address_norm"))),
        "address_token_jaccard": unless(S.jaccard(a("address_tokens"), b("address_tokens"))),
        "address_token_overlap": unless(S.overlap(a("address_tokens"), b("address_tokens"))),
        "postal_code_match": _same("postal_code"),
        "house_number_match": _same("house_number"),
        "house_number_overlap": _flag(
            ((a("house_number") != "") & F.array_contains(b("address_tokens"), a("house_number"))) | ((b("house_number") != "") & F.array_contains(a("address_tokens"), b("house_number")))
        ),
        "numeric_token_overlap": S.overlap(numbers(a), numbers(b)),
        "address_len_diff": F.abs(length(a("address_norm")) - length(b("address_norm"))).cast("double"),
        "address_token_count_diff": unless(F.abs(F.size(a("address_tokens")) - F.size(b("address_tokens"))).cast("double")),
        "address_missing_flag": _flag(missing),
    }
    name, way = F.col("name_levenshtein_sim"), F.col("address_levenshtein_sim")
    derived = {
        "name_sim_x_addr_sim": F.round(name * way, 6),
        "name_sim_plus_addr_sim": F.round(name + way, 6),
        "max_name_addr_sim": F.greatest(name, way),
        "min_name_addr_sim": F.least(name, way),
        "both_exact": F.col("exact_name_match") * F.col("exact_address_match"),
        "name_exact_and_addr_similar": _flag((F.col("exact_name_match") == 1) & (way >= 0.7)),
        "addr_exact_and_name_similar": _flag((F.col("exact_address_match") == 1) & (name >= 0.7)),
        "block_count": F.size("blocks").cast("double"),
        "block_strength_sum": F.aggregate("blocks", F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(strength, x), F.lit(1.0))),
        "exact_name_hit": hit("exact_name"),
        "name_core_hit": hit("name_core"),
        "house_name_hit": hit("house_name"),
        "combined_postal_name_hit": hit("combined_postal_name"),
        "rare_token_hit": hit("rare_token"),
        "char_3gram_hit": _flag(F.exists("blocks", lambda x: x.contains("char_3gram"))),
        "address_token_hit": hit("address_token"),
        "candidate_rank": F.coalesce(F.col("rank"), F.lit(1)).cast("double"),
        "is_source2": _flag(F.col("candidate_entity_id").startswith("S2-")),
        "is_source3": _flag(F.col("candidate_entity_id").startswith("S3-")),
    }
    return pairs.withColumns(own).withColumns(derived)


# Names and order of the base features.
FEATURES = [
    "exact_name_match", "exact_name_core_match", "name_jaro_winkler", "name_levenshtein_sim", "name_token_jaccard", "name_token_overlap",
    "name_sorted_token_sim", "name_char_3gram_jaccard", "name_len_diff", "name_len_ratio", "name_token_count_diff", "first_token_match",
    "last_token_match", "exact_address_match", "address_levenshtein_sim", "address_token_jaccard", "address_token_overlap", "postal_code_match",
    "house_number_match", "house_number_overlap", "numeric_token_overlap", "address_len_diff", "address_token_count_diff", "address_missing_flag",
    "name_sim_x_addr_sim", "name_sim_plus_addr_sim", "max_name_addr_sim", "min_name_addr_sim", "both_exact", "name_exact_and_addr_similar",
    "addr_exact_and_name_similar", "block_count", "block_strength_sum", "exact_name_hit", "name_core_hit", "house_name_hit",
    "combined_postal_name_hit", "rare_token_hit", "char_3gram_hit", "address_token_hit", "candidate_rank", "is_source2", "is_source3",
]
#: Families of blocks that speak independently of each other.
FAMILIES = {
    "name": ["exact_name", "name_core", "rare_token", "char_3gram_k10"],
    "house_postal": ["house_name", "house_token", "combined_postal_name"],
    "address": ["address_token"],
    "web": ["name_web_norm"],
}
TARGETED = ["first_token_sim", "last_token_sim", "shared_tokens", "token_containment", "digit_overlap", "address_containment", "house_x_name", "postal_x_name", "address_len_sim", "has_house_token", "has_web_norm", "independent_blocks"]
CLASSICAL = TARGETED[-3:]
HYBRID = ["name_cosine", "joint_cosine", "rank_decay", "embedding_hit", "embedding_top25", "cosine_x_name", "cosine_x_address", "cosine_x_families"]


def _families(extra: dict[str, list[str]] | None = None) -> Column:
    groups = FAMILIES | (extra or {})
    return sum((_flag(F.arrays_overlap("blocks", F.array(*map(F.lit, names)))) for names in groups.values()), F.lit(0.0))


def targeted_features(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, blocks) with twelve features made for the errors of the base model."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    words = lambda r: F.filter(r("name_tokens"), lambda t: F.length(t) >= 2)
    at = lambda r, i: F.coalesce(F.try_element_at(words(r), F.lit(i)), F.lit(""))
    digits = lambda r: F.regexp_extract_all(r("address_norm"), F.lit(r"\p{Nd}+"), F.lit(0))
    longer = F.greatest(F.length(a("address_norm")), F.length(b("address_norm")))
    contained = S.overlap(words(a), words(b))
    return pairs.withColumns(
        {
            "first_token_sim": S.edit_similarity(at(a, 1), at(b, 1)),
            "last_token_sim": S.edit_similarity(at(a, -1), at(b, -1)),
            "shared_tokens": F.size(F.array_intersect(words(a), words(b))).cast("double"),
            "token_containment": contained,
            "digit_overlap": S.overlap(digits(a), digits(b)),
            "address_containment": S.overlap(a("address_tokens"), b("address_tokens")),
            "house_x_name": _same("house_number") * contained,
            "postal_x_name": _same("postal_code") * contained,
            "address_len_sim": F.when(longer == 0, 1.0).otherwise(1 - F.abs(F.length(a("address_norm")) - F.length(b("address_norm"))) / longer),
            "has_house_token": _flag(F.array_contains("blocks", "house_token")),
            "has_web_norm": _flag(F.array_contains("blocks", "name_web_norm")),
            "independent_blocks": _families(),
        }
    )


def hybrid_features(pairs: DataFrame) -> DataFrame:
    """pairs with base features, name_cosine, joint_cosine and embedding_rank (null: not retrieved) plus the hybrid ones."""
    rank = F.coalesce("embedding_rank", F.lit(200))
    return pairs.withColumns(
        {
            "rank_decay": 1 / (1 + F.log1p(F.least(rank, F.lit(200)))),
            "embedding_hit": _flag(F.col("embedding_rank").isNotNull()),
            "embedding_top25": _flag(F.col("embedding_rank") <= 25),
            "cosine_x_name": F.col("name_cosine") * F.col("name_levenshtein_sim"),
            "cosine_x_address": F.col("name_cosine") * F.col("address_levenshtein_sim"),
            "cosine_x_families": F.col("joint_cosine") * _families({"embedding": ["embedding"]}),
        }
    )


def rule_scores(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """source1_entity_id, candidate_entity_id, blocks, score: the rule that stands in for a trained model where results
    must be the same everywhere: name similarity times address similarity."""
    both = with_records(pairs, queries, targets)
    name = S.edit_similarity(F.col("a.name_norm"), F.col("b.name_norm"))
    way = S.edit_similarity(F.col("a.address_norm"), F.col("b.address_norm"))
    return both.select("source1_entity_id", "candidate_entity_id", "blocks", F.round(name * way, 6).alias("score"))
