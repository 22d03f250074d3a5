"""The resolver's queries: each operator on the test tables, with its statement in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import similarity as S
from ..functions import text as X
from ..operators import blocking, candidates, decision, dense, features, forensics, metrics, model, validate
from ..sources import entities
from . import oracles as O
from . import resolve as R

PAIR = ["source1_entity_id", "candidate_entity_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, rates: list[str] | None = None, digits: int = 6):
    """Register a query. rates: columns of averages and ratios, rounded on both sides."""

    def add(f):
        QUERIES[name] = f if not rates else lambda spark, sf_dir: (lambda df: df.withColumns({c: F.round(c, digits) for c in rates}))(f(spark, sf_dir))
        if oracle:
            ORACLES[name] = O.rounded(rates, oracle, digits) if rates else oracle
        return f

    return add


def _normed(spark, sf_dir):
    """Normalised businesses; their texts are ASCII."""
    return X.normalized(entities.businesses(spark, sf_dir), unicode=False)


def _sides(spark, sf_dir):
    # read by several branches of each plan; dealt out first, as a small file of many rows is a task or two
    n = X.normalized(entities.businesses(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), unicode=False).persist()
    return n.where("entity_id like 'S1-%'"), n.where("entity_id not like 'S1-%'")


def _text_sides(spark, sf_dir):
    """The entities over documents: names with a long tail of words."""
    n = X.normalized(entities.texts(spark, sf_dir), unicode=False).persist()
    return n.where("entity_id like 'S1-%'"), n.where("entity_id not like 'S1-%'")


def _spine(spark, sf_dir):
    return entities.businesses(spark, sf_dir).where("entity_id like 'S1-%'").select(F.col("entity_id").alias("source1_entity_id"))


_truth = entities.business_truth


def _hits(names):
    return lambda spark, sf_dir: blocking.research_hits(*_sides(spark, sf_dir), names)


def _groups(spark, sf_dir):
    """Queries with equal records have equal candidates and truths: one of them is asked for all. So with targets."""
    return entities.business_groups(spark, sf_dir).persist()


def _group_sides(groups):
    """One query, and one target, for all equal ones: few rows are normalised and read again."""
    q, t = entities.business_query_records(groups), entities.business_target_records(None, None, blocking.MOST, groups)
    return X.normalized(q, unicode=False).persist(), X.normalized(t, unicode=False).persist()


def _members(groups):
    return groups.where("source = 'S1'").select("representative", entities.business_ids("keys").alias("ids"))


def _marked(spark, sf_dir, names):
    """Pairs of the representatives, with truth: marks, spine, both sides."""
    g = _groups(spark, sf_dir)
    q, t = _group_sides(g)
    marks, _ = blocking.marked_pairs(q, t, names, entities.business_truth_lists(g))
    return marks, entities.business_spine(g), q, t


def _for_all(spark, sf_dir, names, weights, f):
    """The rows that f makes of the representatives' marked pairs, for every query, with the blocks' names."""
    g = _groups(spark, sf_dir)
    marks, homes = blocking.marked_pairs(*_group_sides(g), names)
    return candidates.for_members(candidates.written_blocks(candidates.named(f(marks), weights, names)), homes, _members(g))


def _production(spark, sf_dir):
    return candidates.production_ranked(blocking.fast_hits(*_sides(spark, sf_dir)))


def _scored(spark, sf_dir):
    return features.rule_scores(_production(spark, sf_dir), *_sides(spark, sf_dir))


def _featured(spark, sf_dir):
    q, t = _sides(spark, sf_dir)
    return features.with_records(candidates.production_ranked(blocking.fast_hits(q, t)), q, t)


def _n_targets(spark, sf_dir):
    return entities.businesses(spark, sf_dir).where("entity_id not like 'S1-%'").count()


# --- sources -------------------------------------------------------------------------------------------------------
query("load_entities", O.with_(O.BUSINESSES, select="SELECT * FROM ev"))(entities.businesses)
query("load_texts", O.with_(O.TEXTS, select="SELECT * FROM ev"))(entities.texts)
query("load_truth", O.with_(O.BUSINESSES, O.TRUTH, select="SELECT * FROM truth"))(_truth)


@query("country_scan", O.with_(O.BUSINESSES, select="SELECT * FROM ev WHERE trim(country) = 'India'"))
def country_scan(spark, sf_dir):
    return entities.of_country(entities.businesses(spark, sf_dir), "India")


@query("head_scan", O.with_(O.BUSINESSES, select="SELECT * FROM ev ORDER BY entity_id LIMIT 100"))
def head_scan(spark, sf_dir):
    return entities.head(entities.businesses(spark, sf_dir), 100)


_PROFILE = ["name_mean", "address_mean"]


@query(
    "profile_sources",
    O.with_(
        O.BUSINESSES,
        select="""
SELECT substr(entity_id, 1, 2) AS source, count(*) AS n, count(DISTINCT entity_id) AS ids, count(*) - count(DISTINCT entity_id) AS repeated_ids,
  count(*) FILTER (trim(business_name) = '') AS empty_names, count(*) FILTER (trim(business_address) = '') AS empty_addresses, count(*) FILTER (trim(country) = '') AS empty_countries,
  count(DISTINCT business_name) AS names, count(DISTINCT business_address) AS addresses, CAST(min(length(business_name)) AS INTEGER) AS name_min, CAST(max(length(business_name)) AS INTEGER) AS name_max,
  avg(length(business_name)) AS name_mean, quantile_cont(length(business_name), 0.5) AS name_median, CAST(min(length(business_address)) AS INTEGER) AS address_min,
  CAST(max(length(business_address)) AS INTEGER) AS address_max, avg(length(business_address)) AS address_mean, quantile_cont(length(business_address), 0.5) AS address_median
FROM ev GROUP BY 1""",
    ),
    _PROFILE,
)
def profile_sources(spark, sf_dir):
    return validate.profile(entities.businesses(spark, sf_dir))


@query("profile_countries", O.with_(O.BUSINESSES, select="SELECT country AS value, count(*) AS n FROM ev GROUP BY 1"))
def profile_countries(spark, sf_dir):
    return validate.value_counts(entities.businesses(spark, sf_dir), "country")


# --- normalisation -------------------------------------------------------------------------------------------------
_NAMES = ["entity_id", "name_norm", "name_core", "name_alnum", "name_sorted_tokens", "name_char_3gram", "name_core_v2", "name_web_collapsed", "country_norm"]
_WAYS = ["entity_id", "address_norm", "address_alnum", "address_sorted_tokens", "postal_code", "house_number", "address_number_tokens"]


@query("normalize_names", O.with_(O.BUSINESSES, O.NORMALIZED, select=f"SELECT {', '.join(_NAMES)} FROM nm"))
def normalize_names(spark, sf_dir):
    return _normed(spark, sf_dir).select(_NAMES)


@query("normalize_addresses", O.with_(O.BUSINESSES, O.NORMALIZED, select=f"SELECT {', '.join(_WAYS)} FROM nm"))
def normalize_addresses(spark, sf_dir):
    return _normed(spark, sf_dir).select(_WAYS)


@query("normalize_texts", O.with_(O.TEXTS, O.NORMALIZED, select="SELECT entity_id, name_norm, name_core, name_sorted_tokens, address_norm, strip_accents(name_norm) AS name_bare FROM nm"))
def normalize_texts(spark, sf_dir):
    n = X.normalized(entities.texts(spark, sf_dir))
    return n.select("entity_id", "name_norm", "name_core", "name_sorted_tokens", "address_norm", X.unaccented(F.col("name_norm")).alias("name_bare"))


@query(
    "normalization_stats",
    O.with_(
        O.BUSINESSES, O.NORMALIZED,
        select="""
SELECT count(*) AS n, count(*) FILTER (name_norm <> business_name) AS names_changed, count(*) FILTER (name_core <> name_norm) AS suffixes_stripped,
  count(*) FILTER (name_norm = '' AND business_name <> '') AS names_emptied, count(*) FILTER (address_norm <> business_address) AS addresses_changed,
  count(*) FILTER (postal_code <> '') AS postal_codes, count(*) FILTER (house_number <> '') AS house_numbers, count(*) FILTER (address_number_tokens <> '') AS with_numbers FROM nm""",
    ),
)
def normalization_stats(spark, sf_dir):
    return validate.normalization_stats(_normed(spark, sf_dir))


@query("url_web_norm", f"SELECT page_id, array_to_string({O._web('url')}, ' ') AS web, array_to_string({O._web('url')}, '') AS collapsed FROM pages")
def url_web_norm(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", X.name_web(F.col("url")).alias("web"), X.name_web_collapsed(F.col("url")).alias("collapsed"))


_SCRIPT = " ".join(f"WHEN ascii(c) BETWEEN {at} AND {at + 127} THEN '{label}'" for at, label in config.SCRIPTS.items())
_SHIFT = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN chr({at + 21})" for i, at in enumerate(config.SCRIPTS)) + " ELSE '' END"


@query("script_detect", f"SELECT doc_id, CASE {_SCRIPT} ELSE 'Latin' END AS script FROM (SELECT doc_id, regexp_extract(coalesce(text, '') || {_SHIFT}, '[\\x{{0900}}-\\x{{0D7F}}]') AS c FROM documents)")
def script_detect(spark, sf_dir):
    """Every text with a letter of one of nine scripts, or none, put after it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = F.element_at(F.array(*[F.lit(chr(at + 21)) for at in config.SCRIPTS], F.lit("")), (F.col("doc_id") % 10 + 1).cast("int"))
    return d.select("doc_id", X.script(F.concat(F.coalesce("text", F.lit("")), letters)).alias("script"))


@query("dual_text", O.with_(O.BUSINESSES, O.NORMALIZED, select="SELECT entity_id, name_norm AS name, CASE WHEN address_norm = '' THEN name_norm ELSE name_norm || ' | ' || address_norm END AS joint, array_to_string(list_transform(name_tokens, lambda t: left(t, 1)), '') AS initials, CASE substr(entity_id, 1, 2) WHEN 'S1' THEN 'source1' WHEN 'S2' THEN 'source2' WHEN 'S3' THEN 'source3' ELSE 'unknown' END AS source FROM nm"))
def dual_text(spark, sf_dir):
    n = _normed(spark, sf_dir)
    return n.select(
        "entity_id", F.trim("name_norm").alias("name"), X.name_and_address(F.col("name_norm"), F.col("address_norm")).alias("joint"), X.initials(F.col("name_norm")).alias("initials"),
        X.source_of(F.col("entity_id")).alias("source"),
    )


# --- blocks --------------------------------------------------------------------------------------------------------
_ALL = list(blocking.RESEARCH)


@query("postings_pruned", O.with_(O.BUSINESSES, O.NORMALIZED, O.postings(_ALL), select="SELECT * FROM post"))
def postings_pruned(spark, sf_dir):
    return blocking.postings(_sides(spark, sf_dir)[1], list(blocking.RESEARCH.values()))


for _name in _ALL:
    if _name in ("name_token", "rare_token", "address_token"):  # names of part are too few: each of their words is over the limits
        query(f"block_{_name}", O.with_(O.TEXTS, O.NORMALIZED, O.hits([_name]), select="SELECT source1_entity_id, candidate_entity_id, source, block, place FROM hits"))(
            lambda spark, sf_dir, name=_name: blocking.research_hits(*_text_sides(spark, sf_dir), [name])
        )
        continue
    query(f"block_{_name}", O.over_hits([_name], "SELECT source1_entity_id, candidate_entity_id, source, block, place FROM hits"))(_hits([_name]))
for _name in blocking.FAST:
    query(f"fast_block_{_name}", O.with_(O.BUSINESSES, O.NORMALIZED, O.fast_hits([_name]), select="SELECT * FROM hits"))(
        lambda spark, sf_dir, name=_name: blocking.fast_hits(*_sides(spark, sf_dir), [name])
    )
_UNITED = "SELECT source1_entity_id, candidate_entity_id, source, array_to_string(blocks, ',') AS blocks, support, strength, top, best_block"
for _kind, _unions in (("base", config.BASE_UNIONS), ("extended", config.EXTENDED_UNIONS)):
    for _letter, _names in _unions.items():
        query(f"union_{_kind}_{_letter}", O.over_hits(_names, f"{_UNITED} FROM pairs", O.united(config.RANK_WEIGHTS)))(
            lambda spark, sf_dir, names=_names: _for_all(spark, sf_dir, names, config.RANK_WEIGHTS, lambda h: candidates.united(h, config.RANK_WEIGHTS, names))
        )
_E, _H = config.BASE_UNIONS["e"], config.EXTENDED_UNIONS["h"]
_RANKED = f"{_UNITED}, rank FROM ranked"


def _ranking(name, names, weights, order, budget, per_source, f):
    query(name, O.over_hits(names, _RANKED, O.united(weights), O.ranked(order, budget, per_source)))(lambda spark, sf_dir: _for_all(spark, sf_dir, names, weights, f))


_ID = "candidate_entity_id"
_ranking("rank_base", _E, config.BASE_WEIGHTS, ["support", "strength", "top", _ID], 200, True, lambda h: candidates.base_ranked(h, names=_E))
_ranking("rank_extended", _H, config.RANK_WEIGHTS, ["support", "strength", "top", _ID], 200, True, lambda h: candidates.extended_ranked(h, names=_H))
_ranking("rank_support", _H, config.RANK_WEIGHTS, ["support", _ID], 200, False, lambda h: candidates.support_ranked(h, names=_H))
_ranking("prune_priority", _E, config.BUDGET_WEIGHTS, ["top", "support", "strength", _ID], 5, False, lambda h: candidates.pruned(h, "priority", 5, _E))
for _budget in (25, 50, 100, 200):
    _ranking(f"prune_priority_{_budget}", _E, config.BUDGET_WEIGHTS, ["top", "support", "strength", _ID], _budget, False, lambda h, n=_budget: candidates.pruned(h, "priority", n, _E))
_ranking("prune_multi_block", _E, config.BUDGET_WEIGHTS, ["support", "strength", "top", _ID], 5, False, lambda h: candidates.pruned(h, "multi_block", 5, _E))


@query("rank_production", O.with_(O.BUSINESSES, O.NORMALIZED, O.PRODUCTION, select=_RANKED))
def rank_production(spark, sf_dir):
    return candidates.written_blocks(_production(spark, sf_dir))


_FIRST = ["exact_name", "name_core", "name_token", "char_3gram_k5", "postal"]
_NUMBER = "CASE block " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(_FIRST)) + " END"


@query(
    "rank_insertion",
    O.over_hits(
        _FIRST,
        f"""
SELECT source1_entity_id, candidate_entity_id, source, blocks, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source1_entity_id, source ORDER BY first_at, candidate_entity_id) AS rank FROM (
    SELECT source1_entity_id, candidate_entity_id, source, min(struct_pack(n := {_NUMBER}, place := place)) AS first_at, array_to_string(list_sort(list(DISTINCT block)), ',') AS blocks FROM hits GROUP BY 1, 2, 3)) WHERE rank <= 50""",
    ),
)
def rank_insertion(spark, sf_dir):
    return candidates.written_blocks(candidates.first_found(_hits(_FIRST)(spark, sf_dir), _FIRST))


# --- candidates against truth --------------------------------------------------------------------------------------
_TARGETS = "(SELECT count(*) FROM nm WHERE source <> 'S1')"


@query(
    "candidate_stats",
    O.with_(
        O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.hits(_E), O.per_query("hits"),
        select=f"""
SELECT count(*) AS n_queries, CAST(sum(n_pred) AS BIGINT) AS n_candidates, CAST(sum(tp) AS BIGINT) AS n_found, CAST(sum(n_true) AS BIGINT) AS n_true, coalesce(sum(tp) / nullif(sum(n_true), 0), 1.0) AS pair_recall,
  coalesce(avg(CASE WHEN n_true > 0 THEN tp / n_true END), 1.0) AS mean_recall, avg(n_pred) AS mean_candidates, quantile_cont(n_pred, 0.5) AS median_candidates, quantile_cont(n_pred, 0.95) AS p95_candidates,
  quantile_cont(n_pred, 0.99) AS p99_candidates, max(n_pred) AS max_candidates, 1 - sum(n_pred) / (count(*) * {_TARGETS}) AS reduction, coalesce(sum(tp) / nullif(sum(n_pred), 0), 0.0) AS precision,
  count(*) FILTER (n_true = 0 AND n_pred > 0) AS exposed_singletons FROM per""",
    ),
    ["pair_recall", "mean_recall", "mean_candidates", "median_candidates", "p95_candidates", "p99_candidates", "reduction", "precision"],
)
def candidate_stats(spark, sf_dir):
    marks, spine, *_ = _marked(spark, sf_dir, _E)
    return candidates.statistics(marks, _E, spine, F.lit(_n_targets(spark, sf_dir)))


_HISTOGRAM = "h AS (SELECT n, count(*) AS queries FROM (SELECT s.source1_entity_id, count(r.candidate_entity_id) AS n FROM spine s LEFT JOIN ranked r USING (source1_entity_id) GROUP BY 1) GROUP BY 1), hc AS (SELECT n, queries, CAST(sum(queries) OVER (ORDER BY n) AS BIGINT) AS cumulated, CAST(sum(queries) OVER () AS BIGINT) AS total FROM h)"


@query("candidate_histogram", O.with_(O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION, _HISTOGRAM, select="SELECT n, queries, cumulated FROM hc"))
def candidate_histogram(spark, sf_dir):
    return candidates.histogram(_production(spark, sf_dir), _spine(spark, sf_dir))


@query(
    "candidate_audit",
    O.with_(
        O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION, _HISTOGRAM,
        select=f"""
SELECT max(total) AS n_queries, CAST(sum(n * queries) AS BIGINT) AS n_candidates, min(n) FILTER (cumulated >= 0.5 * total) AS median, min(n) FILTER (cumulated >= 0.95 * total) AS p95, min(n) FILTER (cumulated >= 0.99 * total) AS p99,
  max(n) AS most, CAST(coalesce(sum(queries) FILTER (n = 0), 0) AS BIGINT) AS without, 1 - sum(n * queries) / (max(total) * {_TARGETS}) AS reduction FROM hc""",
    ),
    ["reduction"],
)
def candidate_audit(spark, sf_dir):
    return candidates.audit(_production(spark, sf_dir), _spine(spark, sf_dir), F.lit(_n_targets(spark, sf_dir)))


@query(
    "incremental_gain",
    O.over_hits(
        _ALL,
        """
SELECT block, count(*) AS added, count(t.target_id) AS gained, count(t.target_id) / count(*) AS gain_rate FROM hits h
LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.source1_entity_id = h.source1_entity_id AND t.target_id = h.candidate_entity_id
WHERE block <> 'name_core' AND NOT EXISTS (SELECT 1 FROM hits b WHERE b.block = 'name_core' AND b.source1_entity_id = h.source1_entity_id AND b.candidate_entity_id = h.candidate_entity_id) GROUP BY 1""",
    ),
    ["gain_rate"],
)
def incremental_gain(spark, sf_dir):
    marks, spine, *_ = _marked(spark, sf_dir, _ALL)
    return candidates.incremental(marks, _ALL, spine)


@query(
    "source_separation",
    O.over_hits(
        _E,
        """
SELECT p.source, p.n_candidates, p.n_found, p.n_queries, coalesce(t.n_true, 0) AS n_true, coalesce(p.n_found / nullif(t.n_true, 0), 1.0) AS recall FROM (
  SELECT source, count(*) AS n_candidates, count(target_id) AS n_found, count(DISTINCT h.source1_entity_id) AS n_queries FROM (SELECT DISTINCT source1_entity_id, candidate_entity_id, source FROM hits) h
  LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.source1_entity_id = h.source1_entity_id AND t.target_id = h.candidate_entity_id GROUP BY 1) p
LEFT JOIN (SELECT substr(target_id, 1, 2) AS source, count(*) AS n_true FROM (SELECT DISTINCT * FROM truth) GROUP BY 1) t ON t.source = p.source""",
    ),
    ["recall"],
)
def source_separation(spark, sf_dir):
    marks, spine, *_ = _marked(spark, sf_dir, _E)
    return candidates.by_source(marks, _E, spine)


@query(
    "singleton_exposure",
    O.over_hits(
        _H,
        """
SELECT block, count(DISTINCT source1_entity_id) AS receivers, count(*) AS n_candidates, (SELECT count(*) FROM lone) AS singletons,
  count(DISTINCT source1_entity_id) / (SELECT count(*) FROM lone) AS rate, count(*) / count(DISTINCT source1_entity_id) AS per_receiver FROM hits WHERE source1_entity_id IN (SELECT * FROM lone) GROUP BY 1""",
        "lone AS (SELECT source1_entity_id FROM spine WHERE source1_entity_id NOT IN (SELECT source1_entity_id FROM truth))",
    ),
    ["rate", "per_receiver"],
)
def singleton_exposure(spark, sf_dir):
    marks, spine, *_ = _marked(spark, sf_dir, _H)
    return candidates.singleton_exposure(marks, _H, spine)


_NEW = ["name_web_norm", "house_token", "name_core_v2", "char_3gram_adaptive"]


@query(
    "recovered_misses",
    O.over_hits(
        ["postal", *_NEW],
        f"""
SELECT t.source1_entity_id, t.target_id AS candidate_entity_id, coalesce(r.by, '') AS recovered_by FROM (SELECT DISTINCT * FROM truth) t
LEFT JOIN (SELECT source1_entity_id, candidate_entity_id, string_agg(DISTINCT block, ',' ORDER BY block) AS by FROM hits WHERE block IN {O.quoted(_NEW)} GROUP BY 1, 2) r ON r.source1_entity_id = t.source1_entity_id AND r.candidate_entity_id = t.target_id
WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.block = 'postal' AND h.source1_entity_id = t.source1_entity_id AND h.candidate_entity_id = t.target_id)""",
    ),
)
def recovered_misses(spark, sf_dir):
    g, names = _groups(spark, sf_dir), ["postal", *_NEW]
    marks, homes = blocking.marked_pairs(*_group_sides(g), names, entities.business_truth_lists(g))
    return candidates.for_members(candidates.recovered(marks, names, "postal", _NEW), homes, _members(g))


@query(
    "block_false_rates",
    O.over_hits(
        _H,
        """
SELECT block, count(*) AS n, count(*) FILTER (target_id IS NULL) AS n_false, count(*) FILTER (target_id IS NULL) / count(*) AS false_rate FROM hits h
LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.source1_entity_id = h.source1_entity_id AND t.target_id = h.candidate_entity_id GROUP BY 1""",
    ),
    ["false_rate"],
)
def block_false_rates(spark, sf_dir):
    marks, spine, *_ = _marked(spark, sf_dir, _H)
    return candidates.false_rates(marks, _H, spine)


# --- features ------------------------------------------------------------------------------------------------------
_G = lambda r: O._tokens(f"{r}.name_char_3gram")
_MISSING = "(a.address_norm = '' OR b.address_norm = '')"
_NUMS = lambda r: f"regexp_extract_all({r}.address_norm, '\\b[0-9]+\\b')"
_same = lambda c: f"CAST(a.{c} = b.{c} AND a.{c} <> '' AS INTEGER)::DOUBLE"
_hit = lambda n: f"CAST(list_contains(r.blocks, '{n}') AS INTEGER)::DOUBLE"
_STRENGTH = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.BASE_WEIGHTS.items()) + " ELSE 1.0 END"
_OWN = {
    "exact_name_match": _same("name_norm"),
    "exact_name_core_match": _same("name_core"),
    "name_jaro_winkler": "CASE WHEN a.name_norm = '' OR b.name_norm = '' THEN 0.0 ELSE jaro_winkler_similarity(a.name_norm, b.name_norm) END",
    "name_levenshtein_sim": O.lev("a.name_norm", "b.name_norm"),
    "name_token_jaccard": O.jaccard("a.name_tokens", "b.name_tokens"),
    "name_token_overlap": O.overlap("a.name_tokens", "b.name_tokens"),
    "name_sorted_token_sim": O.lev("a.name_sorted_tokens", "b.name_sorted_tokens"),
    "name_char_3gram_jaccard": O.jaccard(_G("a"), _G("b")),
    "name_len_diff": "abs(length(a.name_norm) - length(b.name_norm))::DOUBLE",
    "name_len_ratio": "CASE WHEN greatest(length(a.name_norm), length(b.name_norm)) = 0 THEN 1.0 ELSE least(length(a.name_norm), length(b.name_norm)) / greatest(length(a.name_norm), length(b.name_norm)) END",
    "name_token_count_diff": "abs(len(a.name_tokens) - len(b.name_tokens))::DOUBLE",
    "first_token_match": "coalesce(CAST(a.name_tokens[1] = b.name_tokens[1] AS INTEGER), 0)::DOUBLE",
    "last_token_match": "coalesce(CAST(a.name_tokens[-1] = b.name_tokens[-1] AS INTEGER), 0)::DOUBLE",
    "exact_address_match": _same("address_norm"),
    "address_levenshtein_sim": O.lev("a.address_norm", "b.address_norm"),
    "address_token_jaccard": O.jaccard("a.address_tokens", "b.address_tokens"),
    "address_token_overlap": O.overlap("a.address_tokens", "b.address_tokens"),
    "postal_code_match": _same("postal_code"),
    "house_number_match": _same("house_number"),
    "house_number_overlap": "CAST((a.house_number <> '' AND list_contains(b.address_tokens, a.house_number)) OR (b.house_number <> '' AND list_contains(a.address_tokens, b.house_number)) AS INTEGER)::DOUBLE",
    "numeric_token_overlap": O.overlap(_NUMS("a"), _NUMS("b")),
    "address_len_diff": "abs(length(a.address_norm) - length(b.address_norm))::DOUBLE",
    "address_token_count_diff": f"CASE WHEN {_MISSING} THEN 0.0 ELSE abs(len(a.address_tokens) - len(b.address_tokens))::DOUBLE END",
    "address_missing_flag": f"CAST({_MISSING} AS INTEGER)::DOUBLE",
    "block_count": "len(r.blocks)::DOUBLE",
    "block_strength_sum": f"list_sum(list_transform(r.blocks, lambda x: {_STRENGTH}))::DOUBLE",
    "exact_name_hit": _hit("exact_name"), "name_core_hit": _hit("name_core"), "house_name_hit": _hit("house_name"), "combined_postal_name_hit": _hit("combined_postal_name"),
    "rare_token_hit": _hit("rare_token"), "char_3gram_hit": "CAST(len(list_filter(r.blocks, lambda x: contains(x, 'char_3gram'))) > 0 AS INTEGER)::DOUBLE", "address_token_hit": _hit("address_token"),
    "candidate_rank": "r.rank::DOUBLE", "is_source2": "CAST(r.candidate_entity_id LIKE 'S2-%' AS INTEGER)::DOUBLE", "is_source3": "CAST(r.candidate_entity_id LIKE 'S3-%' AS INTEGER)::DOUBLE",
}
_DERIVED = {
    "name_sim_x_addr_sim": "round(name_levenshtein_sim * address_levenshtein_sim, 6)", "name_sim_plus_addr_sim": "round(name_levenshtein_sim + address_levenshtein_sim, 6)",
    "max_name_addr_sim": "greatest(name_levenshtein_sim, address_levenshtein_sim)", "min_name_addr_sim": "least(name_levenshtein_sim, address_levenshtein_sim)",
    "both_exact": "exact_name_match * exact_address_match", "name_exact_and_addr_similar": "CAST(exact_name_match = 1 AND address_levenshtein_sim >= 0.7 AS INTEGER)::DOUBLE",
    "addr_exact_and_name_similar": "CAST(exact_address_match = 1 AND name_levenshtein_sim >= 0.7 AS INTEGER)::DOUBLE",
}
_JOINED = "FROM ranked r JOIN nm a ON a.entity_id = r.source1_entity_id JOIN nm b ON b.entity_id = r.candidate_entity_id"
_RATIOS = [f for f in features.FEATURES if "sim" in f or "jaccard" in f or "overlap" in f or "ratio" in f or "winkler" in f]


@query(
    "pair_features",
    O.with_(
        O.BUSINESSES, O.NORMALIZED, O.PRODUCTION, f"own AS (SELECT r.source1_entity_id, r.candidate_entity_id, {', '.join(f'{v} AS {k}' for k, v in _OWN.items())} {_JOINED})",
        select=f"\nSELECT source1_entity_id, candidate_entity_id, {', '.join(f'{_DERIVED[f]} AS {f}' if f in _DERIVED else f for f in features.FEATURES)} FROM own",
    ),
    _RATIOS,
)
def pair_features(spark, sf_dir):
    return features.base_features(_featured(spark, sf_dir)).select(*PAIR, *features.FEATURES)


_W2 = lambda r: f"list_filter({r}.name_tokens, lambda t: length(t) >= 2)"
_AT = lambda r, i: f"coalesce({_W2(r)}[{i}], '')"
_DIGITS = lambda r: f"regexp_extract_all({r}.address_norm, '[0-9]+')"
_CONTAINED = O.overlap(_W2("a"), _W2("b"))
_FAMILIES = " + ".join(f"CAST(list_has_any(r.blocks, {list(v)}) AS INTEGER)" for v in features.FAMILIES.values())
_TARGETED = {
    "first_token_sim": O.lev(_AT("a", 1), _AT("b", 1)), "last_token_sim": O.lev(_AT("a", -1), _AT("b", -1)),
    "shared_tokens": f"len(list_intersect({_W2('a')}, {_W2('b')}))::DOUBLE", "token_containment": _CONTAINED, "digit_overlap": O.overlap(_DIGITS("a"), _DIGITS("b")),
    "address_containment": O.overlap("a.address_tokens", "b.address_tokens"), "house_x_name": f"{_same('house_number')} * ({_CONTAINED})", "postal_x_name": f"{_same('postal_code')} * ({_CONTAINED})",
    "address_len_sim": "CASE WHEN greatest(length(a.address_norm), length(b.address_norm)) = 0 THEN 1.0 ELSE 1 - abs(length(a.address_norm) - length(b.address_norm)) / greatest(length(a.address_norm), length(b.address_norm)) END",
    "has_house_token": _hit("house_token"), "has_web_norm": _hit("name_web_norm"), "independent_blocks": f"({_FAMILIES})::DOUBLE",
}


@query("targeted_features", O.with_(O.BUSINESSES, O.NORMALIZED, O.PRODUCTION, select=f"\nSELECT r.source1_entity_id, r.candidate_entity_id, {', '.join(f'{v} AS {k}' for k, v in _TARGETED.items())} {_JOINED}"), features.TARGETED, 4)
def targeted_features(spark, sf_dir):
    return features.targeted_features(_featured(spark, sf_dir)).select(*PAIR, *features.TARGETED)


# --- scores, decisions, metrics ------------------------------------------------------------------------------------
@query("rule_scores", O.scored("SELECT source1_entity_id, candidate_entity_id, score FROM scored"))
def rule_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select(*PAIR, "score")


@query("match_threshold", O.scored("SELECT source1_entity_id, candidate_entity_id, score FROM scored WHERE score >= 0.5"))
def match_threshold(spark, sf_dir):
    return decision.matches(_scored(spark, sf_dir)).select(*PAIR, "score")


@query("match_score_gap", O.scored("SELECT source1_entity_id, candidate_entity_id, score FROM (SELECT *, max(score) OVER (PARTITION BY source1_entity_id) AS best FROM scored WHERE score >= 0.5) WHERE best - score <= 0.05"))
def match_score_gap(spark, sf_dir):
    return decision.matches(_scored(spark, sf_dir), gap=0.05).select(*PAIR, "score")


@query("match_supported", O.scored("SELECT source1_entity_id, candidate_entity_id, score FROM scored WHERE score >= 0.5 AND len(blocks) >= 3"))
def match_supported(spark, sf_dir):
    return decision.supported(_scored(spark, sf_dir), 3).select(*PAIR, "score")


_GRID = f"grid AS (SELECT CAST(unnest({config.THRESHOLDS}) AS DOUBLE) AS threshold), kept AS (SELECT threshold, source1_entity_id, candidate_entity_id FROM scored JOIN grid ON score >= threshold)"
_SWEPT = f"swept AS (SELECT threshold, {O.DECISION} FROM per GROUP BY threshold)"
_SWEEP = (O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION, O.RULE, _GRID, O.per_query("kept", by="threshold"), _SWEPT)


@query("threshold_sweep", O.with_(*_SWEEP, select="SELECT * FROM swept"), O.RATES)
def threshold_sweep(spark, sf_dir):
    return decision.sweep(_scored(spark, sf_dir), _truth(spark, sf_dir), _spine(spark, sf_dir))


@query("best_threshold", O.with_(*_SWEEP, select="SELECT * FROM swept ORDER BY round(macro_f05, 9) DESC, threshold LIMIT 1"), O.RATES)
def best_threshold(spark, sf_dir):
    swept = decision.sweep(_scored(spark, sf_dir), _truth(spark, sf_dir), _spine(spark, sf_dir))
    return decision.best_threshold(swept.withColumn("macro_f05", F.round("macro_f05", 9)))


_KEPT = "kept AS (SELECT source1_entity_id, candidate_entity_id FROM scored WHERE score >= 0.5)"
_DECIDED = (O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION, O.RULE, _KEPT, O.per_query("kept"))


@query("decision_metrics", O.with_(*_DECIDED, select=f"SELECT {O.DECISION} FROM per"), O.RATES)
def decision_metrics(spark, sf_dir):
    return metrics.decision_metrics(decision.matches(_scored(spark, sf_dir)), _truth(spark, sf_dir), _spine(spark, sf_dir))


@query(
    "macro_f05",
    O.with_(*_DECIDED, select=f"SELECT avg({O.F05}) AS macro_f05, coalesce(avg({O.F05}) FILTER (n_true = 0), 1.0) AS singleton_accuracy, coalesce(avg({O.F05}) FILTER (n_true > 0), 0.0) AS non_singleton_f05, count(*) AS n_queries FROM per"),
    ["macro_f05", "singleton_accuracy", "non_singleton_f05"],
)
def macro_f05(spark, sf_dir):
    return metrics.macro_f05(decision.matches(_scored(spark, sf_dir)), _truth(spark, sf_dir), _spine(spark, sf_dir))


@query(
    "independent_metrics",
    O.with_(*_DECIDED, select=f"SELECT avg({O.F05}) AS macro_f05, avg(CASE WHEN n_pred > 0 THEN tp / n_pred WHEN n_true = 0 THEN 1.0 ELSE 0.0 END) AS macro_precision, avg(CASE WHEN n_true = 0 THEN 1.0 ELSE tp / n_true END) AS macro_recall FROM per"),
    ["macro_f05", "macro_precision", "macro_recall"],
)
def independent_metrics(spark, sf_dir):
    return metrics.independent_metrics(decision.matches(_scored(spark, sf_dir)), _truth(spark, sf_dir), _spine(spark, sf_dir))


_FATE = "fate AS (SELECT t.*, r.candidate_entity_id AS c, k.candidate_entity_id AS p FROM (SELECT DISTINCT * FROM truth) t LEFT JOIN ranked r ON r.source1_entity_id = t.source1_entity_id AND r.candidate_entity_id = t.target_id LEFT JOIN kept k ON k.source1_entity_id = t.source1_entity_id AND k.candidate_entity_id = t.target_id)"
_CEILING = "count(*) AS n_true, count(c) AS in_candidates, count(p) AS predicted, count(*) FILTER (c IS NULL) AS blocking_misses, count(*) FILTER (c IS NOT NULL AND p IS NULL) AS model_misses, coalesce(count(c) / nullif(count(*), 0), 1.0) AS candidate_recall, coalesce(count(p) / nullif(count(c), 0), 0.0) AS model_recall, coalesce(count(p) / nullif(count(*), 0), 1.0) AS end_to_end_recall"


@query("recall_ceiling", O.with_(*_DECIDED[:-1], _FATE, select=f"SELECT {_CEILING} FROM fate"), ["candidate_recall", "model_recall", "end_to_end_recall"])
def recall_ceiling(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return metrics.recall_ceiling(s, decision.matches(s), _truth(spark, sf_dir))


@query(
    "conservation_checks",
    O.with_(
        *_DECIDED, _FATE, f"m AS (SELECT {O.DECISION} FROM per)", f"c AS (SELECT {_CEILING} FROM fate)",
        select="""
SELECT 'true positives and misses are all truths' AS "check", total_true_positives + missed_true_pairs_count = total_true_matches AS holds FROM m
UNION ALL SELECT 'true positives and false merges are all predictions', total_true_positives + false_merges_count = total_predicted_matches FROM m
UNION ALL SELECT 'end-to-end recall is candidate recall times model recall', abs(end_to_end_recall - candidate_recall * model_recall) < 1e-9 FROM c
UNION ALL SELECT 'misses are blocking misses and model misses', n_true = predicted + blocking_misses + model_misses FROM c""",
    ),
)
def conservation_checks(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return metrics.conservation(s, decision.matches(s), _truth(spark, sf_dir), _spine(spark, sf_dir))


@query(
    "false_merge_overlap",
    O.with_(
        *_DECIDED[:-1],
        "x AS (SELECT source1_entity_id AS q, candidate_entity_id AS c FROM scored WHERE score >= 0.5 EXCEPT SELECT source1_entity_id, target_id FROM truth)",
        "y AS (SELECT source1_entity_id AS q, candidate_entity_id AS c FROM scored WHERE score >= 0.3 AND len(blocks) >= 3 EXCEPT SELECT source1_entity_id, target_id FROM truth)",
        select="SELECT (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)) AS only_first, (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) AS only_second, (SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS both",
    ),
)
def false_merge_overlap(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return metrics.model_overlap(decision.matches(s), decision.supported(s, 3, 0.3), _truth(spark, sf_dir))


@query(
    "score_distribution",
    O.scored("SELECT count(*) AS n, avg(score) AS mean, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.9) AS p90 FROM scored"),
    ["mean", "p10", "p25", "p50", "p75", "p90"],
)
def score_distribution(spark, sf_dir):
    return metrics.score_distribution(_scored(spark, sf_dir))


@query("score_buckets", O.scored("SELECT CAST(floor(score / 0.1) AS BIGINT) AS bucket, count(*) AS n FROM scored WHERE score < 0.5 GROUP BY 1"))
def score_buckets(spark, sf_dir):
    return metrics.score_buckets(_scored(spark, sf_dir))


@query(
    "house_token_variants",
    O.with_(
        O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION,
        f"x AS (SELECT t.target_id IS NOT NULL AS hit, {O.lev('a.name_norm', 'b.name_norm')} AS lev, len(list_intersect(a.address_tokens, b.address_tokens)) AS common {_JOINED} LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.source1_entity_id = r.source1_entity_id AND t.target_id = r.candidate_entity_id WHERE list_contains(r.blocks, 'house_token'))",
        "y AS (SELECT 'a' AS variant, hit, true AS passes FROM x UNION ALL SELECT 'b', hit, lev >= 0.25 FROM x UNION ALL SELECT 'c', hit, lev >= 0.35 FROM x UNION ALL SELECT 'd', hit, common >= 2 FROM x)",
        select="SELECT variant, count(*) FILTER (passes AND hit) AS true_pairs, count(*) FILTER (passes AND NOT hit) AS false_pairs, coalesce(count(*) FILTER (passes AND hit) / nullif(count(*) FILTER (passes), 0), 0.0) AS precision FROM y GROUP BY 1",
    ),
)
def house_token_variants(spark, sf_dir):
    f = _featured(spark, sf_dir).withColumn("name_levenshtein_sim", S.edit_similarity(F.col("a.name_norm"), F.col("b.name_norm")))
    return decision.house_token_variants(f, _truth(spark, sf_dir))


# --- submission ----------------------------------------------------------------------------------------------------
_LISTS = "sub AS (SELECT s.source1_entity_id, coalesce(string_agg(DISTINCT k.candidate_entity_id, ',' ORDER BY k.candidate_entity_id), '') AS matched_entity_ids FROM spine s LEFT JOIN kept k USING (source1_entity_id) GROUP BY 1)"


@query("submission_rows", O.with_(*_DECIDED[:-1], _LISTS, select="SELECT * FROM sub"))
def submission_rows(spark, sf_dir):
    return decision.submission(decision.matches(_scored(spark, sf_dir)), _spine(spark, sf_dir))


_PLANTED = """
numbered AS (SELECT source1_entity_id, nullif(matched_entity_ids, '') AS l, CAST(string_split(source1_entity_id, '-')[2] AS BIGINT) AS n FROM sub),
planted AS (
  SELECT source1_entity_id, concat_ws(',', l, CASE WHEN n % 7 = 0 THEN l END, CASE WHEN n % 11 = 0 THEN 'S1-5' END, CASE WHEN n % 13 = 0 THEN ' X9-7 ,,S2-999999999' END) AS l
  FROM numbered CROSS JOIN (VALUES (1), (2)) AS copies(copy) WHERE n % 17 <> 0 AND (copy = 1 OR n % 19 = 0) UNION ALL SELECT 'S1-surplus', ''),
ids AS (SELECT source1_entity_id, trim(x) AS id FROM (SELECT source1_entity_id, unnest(string_split(l, ',')) AS x FROM planted) WHERE trim(x) <> '')"""


@query(
    "validate_submission",
    O.with_(
        *_DECIDED[:-1], _LISTS, _PLANTED,
        select="""
SELECT 'duplicate query' AS problem, count(*) AS n FROM (SELECT 1 FROM planted GROUP BY source1_entity_id HAVING count(*) > 1)
UNION ALL SELECT 'duplicate id in a list', count(*) FROM (SELECT 1 FROM ids GROUP BY source1_entity_id, id HAVING count(*) > 1)
UNION ALL SELECT 'source 1 id', count(*) FROM ids WHERE id LIKE 'S1-%' UNION ALL SELECT 'unknown prefix', count(*) FROM ids WHERE NOT regexp_matches(id, '^S[123]-')
UNION ALL SELECT 'missing query', count(*) FROM spine WHERE source1_entity_id NOT IN (SELECT source1_entity_id FROM planted)
UNION ALL SELECT 'surplus query', count(*) FROM (SELECT DISTINCT source1_entity_id FROM planted) WHERE source1_entity_id NOT IN (SELECT source1_entity_id FROM spine)
UNION ALL SELECT 'unknown id', count(*) FROM ids WHERE id NOT IN (SELECT entity_id FROM ev)""",
    ),
)
def validate_submission(spark, sf_dir):
    """The resolver's own submission with planted faults: lists twice, ids of source 1, of unknown sources and unknown ids,
    rows left out, repeated and added."""
    n, own = F.split("source1_entity_id", "-")[1].cast("long"), F.nullif("matched_entity_ids", F.lit(""))
    extra = [F.when(n % 7 == 0, own), F.when(n % 11 == 0, F.lit("S1-5")), F.when(n % 13 == 0, F.lit(" X9-7 ,,S2-999999999"))]
    rows = submission_rows(spark, sf_dir).where(n % 17 != 0).select("source1_entity_id", F.concat_ws(",", own, *extra).alias("matched_entity_ids"))
    planted = rows.union(rows.where(n % 19 == 0)).union(spark.range(1).select(F.lit("S1-surplus"), F.lit("")))
    return validate.submission_problems(planted, "matched_entity_ids", _spine(spark, sf_dir), entities.businesses(spark, sf_dir))


@query("containment_audit", O.scored("SELECT source1_entity_id, candidate_entity_id AS id FROM scored WHERE score >= 0.5 AND rank > 3"))
def containment_audit(spark, sf_dir):
    """Matches against a candidate list cut to three: what is matched but not listed."""
    spine, ranked = _spine(spark, sf_dir), _production(spark, sf_dir)
    s = features.rule_scores(ranked, *_sides(spark, sf_dir))
    return validate.outside_candidates(decision.submission(decision.matches(s), spine), decision.submission(ranked.where("rank <= 3"), spine, "candidate_entity_ids"))


@query("resume_pending", O.with_(O.BUSINESSES, select="SELECT entity_id FROM ev WHERE entity_id LIKE 'S1-%' AND entity_id NOT IN (SELECT entity_id FROM ev WHERE country = 'India')"))
def resume_pending(spark, sf_dir):
    """Queries still to do when those of one country are done."""
    b = entities.businesses(spark, sf_dir)
    done = b.where("country = 'India'").select(F.col("entity_id").alias("source1_entity_id"))
    return decision.pending(b.where("entity_id like 'S1-%'"), done).select("entity_id")


@query("truth_pairs", O.with_(O.BUSINESSES, O.TRUTH, select="SELECT DISTINCT source1_entity_id, target_id FROM truth WHERE target_id IN (SELECT entity_id FROM ev WHERE country = 'India')"))
def truth_pairs(spark, sf_dir):
    """Lists of matched ids taken apart again, and scoped to the targets of one country."""
    return entities.truth_pairs(truth_lists(spark, sf_dir), entities.businesses(spark, sf_dir).where("country = 'India'"))


@query("truth_lists", O.with_(O.BUSINESSES, O.TRUTH, select="SELECT source1_entity_id, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS matched_entity_ids FROM truth GROUP BY 1"))
def truth_lists(spark, sf_dir):
    lists = _truth(spark, sf_dir).groupBy("source1_entity_id").agg(F.array_sort(F.collect_set("target_id")).alias("ids"))
    return lists.select("source1_entity_id", entities.id_list(F.col("ids")).alias("matched_entity_ids"))


# --- labels and forensics ------------------------------------------------------------------------------------------
_LEVN, _LEVA = O.lev("a.name_norm", "b.name_norm"), O.lev("a.address_norm", "b.address_norm")
_eq = lambda c: f"(a.{c} = b.{c} AND a.{c} <> '')"
_LADDER = f"""CASE WHEN {_eq('name_norm')} THEN 'Same Name' WHEN {_eq('name_core')} THEN 'Same Core Name' WHEN {_eq('address_norm')} THEN 'Same Address'
WHEN {_eq('house_number')} AND a.name_core <> b.name_core THEN 'Same House Number' WHEN {_eq('postal_code')} AND a.name_core <> b.name_core THEN 'Same Postal Code' WHEN r.support >= 2 THEN 'Multi-Block'
WHEN {_LEVN} >= 0.75 THEN 'High Name Similarity' WHEN {_LEVA} >= 0.75 THEN 'High Address Similarity' ELSE 'Standard Candidate Negative' END"""
_LABELLED = f"lab AS (SELECT r.source1_entity_id, r.candidate_entity_id, CAST(t.target_id IS NOT NULL AS INTEGER) AS label, {_LADDER} AS category {_JOINED} LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.source1_entity_id = r.source1_entity_id AND t.target_id = r.candidate_entity_id)"


def _labelled(spark, sf_dir):
    return forensics.labelled(_featured(spark, sf_dir), _truth(spark, sf_dir)).select(*PAIR, "label", forensics.negative_category().alias("category"))


query("label_ladder", O.with_(O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION, _LABELLED, select="SELECT * FROM lab"))(_labelled)


@query(
    "sampled_pairs",
    O.with_(
        O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION, _LABELLED,
        select="SELECT source1_entity_id, candidate_entity_id, label, category FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id, label ORDER BY CAST(category <> 'Standard Candidate Negative' AS INTEGER) DESC, md5('train' || source1_entity_id || candidate_entity_id)) AS r FROM lab) WHERE label = 1 OR r <= 4",
    ),
)
def sampled_pairs(spark, sf_dir):
    return forensics.sampled(_labelled(spark, sf_dir), 4, "train")


@query("group_split", O.with_(O.BUSINESSES, O.TRUTH, select="SELECT source1_entity_id, CASE WHEN row_number() OVER (ORDER BY md5(source1_entity_id)) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'valid' END AS part FROM spine"))
def group_split(spark, sf_dir):
    return forensics.group_split(_spine(spark, sf_dir))


_REASON = f"CASE WHEN a.name_norm = b.name_norm THEN 'same_name' WHEN a.name_core = b.name_core THEN 'same_core' WHEN {_eq('house_number')} THEN 'same_house' WHEN {_eq('postal_code')} THEN 'same_postal' WHEN {_eq('address_norm')} THEN 'same_address' ELSE '' END"


@query("mined_negatives", O.with_(O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION, select=f"SELECT * FROM (SELECT r.source1_entity_id, r.candidate_entity_id, {_REASON} AS reason {_JOINED}) x WHERE reason <> '' AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.source1_entity_id = x.source1_entity_id AND t.target_id = x.candidate_entity_id)"))
def mined_negatives(spark, sf_dir):
    return forensics.mined_negatives(_featured(spark, sf_dir), _truth(spark, sf_dir))


_RAW = lambda r: f"list_filter(string_split(lower({r}.business_name), ' '), lambda t: t <> '')"
_SPECIFIC = lambda r: f"list_filter({_RAW(r)}, lambda t: t NOT IN {O.quoted(forensics.GENERIC)})"
_NOV, _AOV = O.overlap("a.name_tokens", "b.name_tokens"), O.overlap("a.address_tokens", "b.address_tokens")
_FP = f"""CASE WHEN ({_eq('name_norm')} OR {_NOV} >= 0.70) AND ({_eq('address_norm')} OR {_AOV} >= 0.75) THEN 'C'
WHEN {_eq('house_number')} AND regexp_matches(lower(a.business_address || ' ' || b.business_address), '{'|'.join(forensics.COMMERCIAL)}') AND {_NOV} < 0.35 THEN 'D'
WHEN ({_eq('address_norm')} OR {_AOV} >= 0.65 OR ({_eq('house_number')} AND {_LEVA} >= 0.60)) AND {_NOV} < 0.35 AND {_LEVN} < 0.50 THEN 'A'
WHEN ({_eq('name_norm')} OR {_NOV} >= 0.75 OR {_LEVN} >= 0.85) AND {_AOV} < 0.25 AND NOT {_eq('house_number')} THEN 'B'
WHEN regexp_matches(lower(a.business_name || ' ' || b.business_name), 'dba|t/a') OR ({_NOV} >= 0.60 AND len({_RAW('a')}) <> len({_RAW('b')})) THEN 'F'
WHEN {_NOV} >= 0.50 AND ({_AOV} >= 0.30 OR {_eq('house_number')}) THEN 'E'
WHEN len({_SPECIFIC('a')}) > 0 AND len({_SPECIFIC('b')}) > 0 AND NOT list_has_any({_SPECIFIC('a')}, {_SPECIFIC('b')}) THEN 'G' ELSE 'H' END"""
_FPR = f"coalesce(nullif(concat_ws(' | ', CASE WHEN {_eq('name_norm')} THEN 'same name' END, CASE WHEN {_eq('name_core')} THEN 'same core' END, CASE WHEN {_eq('address_norm')} THEN 'same address' END, CASE WHEN {_eq('house_number')} AND {_LEVN} >= 0.70 THEN 'same house, similar name' END), ''), 'general')"


@query(
    "fp_forensics",
    O.with_(O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION, select=f"SELECT r.source1_entity_id, r.candidate_entity_id, {_FP} AS category, {_FPR} AS reasons {_JOINED} WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.source1_entity_id = r.source1_entity_id AND t.target_id = r.candidate_entity_id)"),
)
def fp_forensics(spark, sf_dir):
    false = forensics.labelled(_featured(spark, sf_dir), _truth(spark, sf_dir)).where("label = 0")
    return false.select(*PAIR, forensics.false_positive_category().alias("category"), forensics.false_merge_reasons().alias("reasons"))


_MISSED = "missed AS (SELECT DISTINCT t.source1_entity_id, t.target_id AS candidate_entity_id FROM truth t LEFT JOIN (SELECT DISTINCT source1_entity_id, candidate_entity_id FROM hits) h ON h.source1_entity_id = t.source1_entity_id AND h.candidate_entity_id = t.target_id WHERE h.source1_entity_id IS NULL)"
_MJOIN = "FROM missed r JOIN nm a ON a.entity_id = r.source1_entity_id JOIN nm b ON b.entity_id = r.candidate_entity_id"
_INITIALS = lambda r: f"array_to_string(list_transform({r}.name_tokens, lambda t: left(t, 1)), '')"
_MR = f"coalesce(nullif(concat_ws(' | ', CASE WHEN {_MISSING} THEN 'address missing' END, CASE WHEN {_LEVN} < 0.40 THEN 'alias or other name' END, CASE WHEN {_LEVN} >= 0.70 THEN 'high similarity lost' END, CASE WHEN {_eq('house_number')} AND coalesce(a.name_tokens[1], '') <> coalesce(b.name_tokens[1], '') THEN 'same house, other first word' END, CASE WHEN {_INITIALS('a')} = {_INITIALS('b')} AND {_LEVN} < 0.70 THEN 'same initials' END), ''), 'general tail')"


def _missed(spark, sf_dir):
    q, t = _sides(spark, sf_dir)
    return features.with_records(forensics.misses(_truth(spark, sf_dir), blocking.research_hits(q, t, ["exact_name"])), q, t)


@query("miss_reasons", O.over_hits(["exact_name"], f"SELECT r.source1_entity_id, r.candidate_entity_id, {_MR} AS reasons, CASE WHEN trim(b.business_address) = '' THEN '2 Missing' WHEN {_LEVN} < 0.40 AND {_NOV} < 0.30 THEN '4 DBA' ELSE '3 OCR' END AS category {_MJOIN}", _MISSED))
def miss_reasons(spark, sf_dir):
    return _missed(spark, sf_dir).select(*PAIR, forensics.miss_reasons().alias("reasons"), forensics.blocking_miss_category().alias("category"))


@query("miss_summary", O.over_hits(["exact_name"], f"SELECT substr(candidate_entity_id, 1, 2) AS source, a.country_norm AS country, CAST(floor(({_LEVN}) * 10) AS BIGINT) AS tenth, count(*) AS n {_MJOIN} GROUP BY ALL", _MISSED))
def miss_summary(spark, sf_dir):
    return forensics.miss_summary(_missed(spark, sf_dir))


@query(
    "transformations",
    O.with_(
        O.BUSINESSES, O.NORMALIZED, O.TRUTH,
        select="""
SELECT t.source1_entity_id, t.target_id AS candidate_entity_id, CASE WHEN lower(a.business_name) = lower(b.business_name) THEN 'same' WHEN a.name_sorted_tokens = b.name_sorted_tokens THEN 'word order' WHEN a.name_core = b.name_core THEN 'suffix'
  WHEN contains(a.business_name || b.business_name, '&') THEN 'ampersand' ELSE 'spelling' END AS name_change,
  CASE WHEN lower(a.business_address) = lower(b.business_address) THEN 'same' WHEN a.address_norm = b.address_norm THEN 'abbreviation' WHEN trim(b.business_address) = '' THEN 'empty' ELSE 'formatting' END AS address_change
FROM truth t JOIN nm a ON a.entity_id = t.source1_entity_id JOIN nm b ON b.entity_id = t.target_id""",
    ),
)
def transformations(spark, sf_dir):
    pairs = _truth(spark, sf_dir).withColumnRenamed("target_id", "candidate_entity_id")
    return forensics.transformations(features.with_records(pairs, *_sides(spark, sf_dir)))


# --- dense retrieval -----------------------------------------------------------------------------------------------
def _vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return e.where("id % 20 = 0"), e


def _same_label(q, t):
    pairs = q.select(F.col("id").alias("query_id"), "label").join(t.select(F.col("id").alias("target_id"), "label"), "label")
    return pairs.where("query_id <> target_id")


def _dense(spark, sf_dir, k=200):
    q, t = _vectors(spark, sf_dir)
    return dense.top_k(q, t, k)


_DENSE = """
e AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings),
d AS (SELECT q.id AS query_id, t.id AS target_id, round(list_dot_product(q.v::DOUBLE[], t.v::DOUBLE[]), 9) AS score, q.label = t.label AS same FROM e q JOIN e t ON q.id % 20 = 0 AND t.id <> q.id),
top AS (SELECT * FROM (SELECT query_id, target_id, score, same, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS INTEGER) AS rank FROM d) WHERE rank <= 200)"""


@query("dense_topk", O.with_(_DENSE, select="\nSELECT query_id, target_id, score, rank FROM top WHERE rank <= 10"), ["score"])
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10)


@query("dense_merge", O.with_(_DENSE, select="\nSELECT query_id, target_id, score, rank FROM top WHERE rank <= 20"), ["score"])
def dense_merge(spark, sf_dir):
    """Two indexes searched apart and merged."""
    q, t = _vectors(spark, sf_dir)
    return dense.merged(*(dense.top_k(q, t.where(f"id % 2 = {i}"), 20).drop("rank") for i in (0, 1)), k=20)


@query(
    "dense_recall_at_k",
    O.with_(_DENSE, "rel AS (SELECT * FROM d WHERE same)", select="\nSELECT k, (SELECT count(*) FROM rel) AS n_relevant, (SELECT count(*) FROM top WHERE same AND rank <= k) AS n_found, (SELECT count(*) FROM top WHERE same AND rank <= k) / (SELECT count(*) FROM rel) AS recall FROM (VALUES (10), (25), (50), (100), (200)) AS x(k)"),
    ["recall"],
)
def dense_recall_at_k(spark, sf_dir):
    q, t = _vectors(spark, sf_dir)
    relevant = _same_label(q, t).drop("label")
    return dense.recall_at(dense.top_k(q, t, 200), relevant, [10, 25, 50, 100, 200])


_CLASSICAL = "cl AS (SELECT q.id AS query_id, t.id AS target_id, 'classical' AS blocks FROM e q JOIN e t ON q.label = t.label AND q.id % 20 = 0 AND t.id <> q.id)"


def _classical(spark, sf_dir):
    q, t = _vectors(spark, sf_dir)
    return _same_label(q, t).select("query_id", "target_id", F.array(F.lit("classical")).alias("blocks"))


@query("hybrid_candidates", O.with_(_DENSE, _CLASSICAL, select="SELECT coalesce(c.query_id, t.query_id) AS query_id, coalesce(c.target_id, t.target_id) AS target_id, coalesce(blocks, 'embedding') AS blocks, coalesce(rank, 999) AS embedding_rank, rank IS NOT NULL AS embedding_hit FROM cl c FULL JOIN (SELECT * FROM top WHERE rank <= 25) t ON t.query_id = c.query_id AND t.target_id = c.target_id"))
def hybrid_candidates(spark, sf_dir):
    return dense.hybrid(_classical(spark, sf_dir), _dense(spark, sf_dir, 25), 25).withColumn("blocks", F.array_join("blocks", ",")).na.fill(999, ["embedding_rank"])


@query("dense_rank_of", O.with_(_DENSE, _CLASSICAL, select="SELECT c.query_id, c.target_id, coalesce(rank, 999) AS rank FROM cl c LEFT JOIN top t ON t.query_id = c.query_id AND t.target_id = c.target_id"))
def dense_rank_of(spark, sf_dir):
    return dense.rank_of(_classical(spark, sf_dir).drop("blocks"), _dense(spark, sf_dir))


@query("dense_hard_negatives", O.with_(_DENSE, select="\nSELECT query_id, target_id, score, rank FROM top WHERE rank <= 25 AND score >= 0.2 AND NOT same"), ["score"])
def dense_hard_negatives(spark, sf_dir):
    q, t = _vectors(spark, sf_dir)
    relevant = _same_label(q, t).drop("label")
    return dense.hard_negatives(dense.top_k(q, t, 25), relevant, 25, 0.2)


_ONE_BLOCK = "house_name"


@query(
    "block_investigation",
    O.over_hits(
        _E,
        f"""
SELECT true_pairs, false_pairs, same_house, same_name, same_postal, same_address, only_here, true_s2, true_s3, singletons, all_s2, all_s3, coalesce(true_pairs / nullif(true_pairs + false_pairs, 0), 0.0) AS precision,
  coalesce(true_s2 / nullif(all_s2, 0), 0.0) AS recall_s2, coalesce(true_s3 / nullif(all_s3, 0), 0.0) AS recall_s3 FROM (
  SELECT count(*) FILTER (hit) AS true_pairs, count(*) FILTER (NOT hit) AS false_pairs, count(*) FILTER (hit AND house) AS same_house, count(*) FILTER (hit AND name) AS same_name, count(*) FILTER (hit AND postal) AS same_postal,
    count(*) FILTER (hit AND way) AS same_address, count(*) FILTER (hit AND NOT other) AS only_here, count(*) FILTER (hit AND c LIKE 'S2%') AS true_s2, count(*) FILTER (hit AND c LIKE 'S3%') AS true_s3,
    count(DISTINCT q) FILTER (NOT has_truth) AS singletons FROM x), (SELECT count(*) FILTER (target_id LIKE 'S2%') AS all_s2, count(*) FILTER (target_id LIKE 'S3%') AS all_s3 FROM (SELECT DISTINCT * FROM truth))""",
        f"""x AS (SELECT h.source1_entity_id AS q, h.candidate_entity_id AS c, EXISTS (SELECT 1 FROM truth t WHERE t.source1_entity_id = h.source1_entity_id AND t.target_id = h.candidate_entity_id) AS hit,
  EXISTS (SELECT 1 FROM truth t WHERE t.source1_entity_id = h.source1_entity_id) AS has_truth,
  EXISTS (SELECT 1 FROM hits o WHERE o.block <> '{_ONE_BLOCK}' AND o.source1_entity_id = h.source1_entity_id AND o.candidate_entity_id = h.candidate_entity_id) AS other,
  a.house_number = b.house_number AND a.house_number <> '' AS house, a.name_norm = b.name_norm OR a.name_core = b.name_core AS name, a.postal_code = b.postal_code AND a.postal_code <> '' AS postal, a.address_norm = b.address_norm AND a.address_norm <> '' AS way
  FROM hits h JOIN nm a ON a.entity_id = h.source1_entity_id JOIN nm b ON b.entity_id = h.candidate_entity_id WHERE h.block = '{_ONE_BLOCK}')""",
    ),
    ["precision", "recall_s2", "recall_s3"],
)
def block_investigation(spark, sf_dir):
    marks, spine, q, t = _marked(spark, sf_dir, _E)
    pairs = marks.where(F.array_contains(blocking.marked(_E, F.col("marks")), _ONE_BLOCK))
    targets = entities.business_target_classes(spark, sf_dir).select(F.col("entity_id").alias("candidate_entity_id"), "representative")
    b = t.select(F.col("entity_id").alias("representative"), F.struct(*candidates.INVESTIGATED).alias("b"))
    a = q.select(F.col("entity_id").alias("source1_entity_id"), F.struct(*candidates.INVESTIGATED).alias("a"))
    featured = pairs.join(targets, "candidate_entity_id").join(b, "representative").join(a, "source1_entity_id")
    return candidates.block_investigation(marks, _E, spine, featured, _ONE_BLOCK)


@query(
    "miss_kinds",
    O.with_(
        *_DECIDED[:-1],
        select="""
SELECT t.source1_entity_id, t.target_id AS candidate_entity_id, CASE WHEN r.rank IS NULL THEN 'A Blocking' ELSE 'B Model' END AS kind
FROM (SELECT DISTINCT * FROM truth) t LEFT JOIN (SELECT source1_entity_id, candidate_entity_id, rank FROM ranked WHERE rank <= 2) r ON r.source1_entity_id = t.source1_entity_id AND r.candidate_entity_id = t.target_id
LEFT JOIN (SELECT source1_entity_id, candidate_entity_id, score FROM scored WHERE score >= 0.95) k ON k.source1_entity_id = t.source1_entity_id AND k.candidate_entity_id = t.target_id WHERE k.score IS NULL""",
    ),
)
def miss_kinds(spark, sf_dir):
    """With a high threshold, and candidates cut to two."""
    ranked = _production(spark, sf_dir)
    s = features.rule_scores(ranked, *_sides(spark, sf_dir))
    return forensics.miss_kinds(_truth(spark, sf_dir), ranked.where("rank <= 2"), decision.matches(s, 0.95))


_PSEUDO = "CAST(('0x' || substr(md5(r.source1_entity_id || r.candidate_entity_id), 1, 4)) AS INTEGER)"
_SAMPLE = f"""pool AS (SELECT r.source1_entity_id, r.candidate_entity_id, CAST(t.target_id IS NOT NULL AS INTEGER) AS label, r.support, r.blocks, r.rank % 3 = 0 AS hit, {_PSEUDO} / 65536 AS cosine
  FROM ranked r LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.source1_entity_id = r.source1_entity_id AND t.target_id = r.candidate_entity_id),
kinds AS (SELECT *, CASE WHEN label = 1 THEN 'positive' WHEN hit AND cosine >= 0.70 THEN 'embedding' WHEN support >= 2 OR list_contains(blocks, 'house_token') THEN 'classical' ELSE 'random' END AS kind, md5(source1_entity_id || candidate_entity_id) AS h FROM pool),
placed AS (SELECT *, row_number() OVER (PARTITION BY source1_entity_id, kind ORDER BY CASE kind WHEN 'embedding' THEN -cosine WHEN 'classical' THEN -CAST(support AS DOUBLE) END, h) AS r FROM kinds),
counted AS (SELECT *, count(*) FILTER (kind IN ('embedding', 'classical') AND r <= 2) OVER (PARTITION BY source1_entity_id) AS hard FROM placed)"""


@query("hybrid_sampled", O.with_(O.BUSINESSES, O.NORMALIZED, O.TRUTH, O.PRODUCTION, _SAMPLE, select="SELECT source1_entity_id, candidate_entity_id, label, kind FROM counted WHERE CASE kind WHEN 'positive' THEN true WHEN 'random' THEN r <= 6 - hard ELSE r <= 2 END"))
def hybrid_sampled(spark, sf_dir):
    """With cosines made from a hash, as the entity tables have no vectors."""
    pseudo = F.conv(F.substring(F.md5(F.concat(*PAIR).cast("binary")), 1, 4), 16, 10).cast("int") / 65536
    pairs = forensics.labelled(_production(spark, sf_dir), _truth(spark, sf_dir)).withColumn("embedding_hit", F.col("rank") % 3 == 0).withColumn("cosine", pseudo)
    return forensics.hybrid_sampled(pairs, 6, 2).select(*PAIR, "label", "kind")


@query(
    "recovery_status",
    O.over_hits(
        ["exact_name"],
        """
SELECT m.source1_entity_id, m.candidate_entity_id, coalesce(r.rank, 999) AS embedding_rank, CASE WHEN r.rank <= 10 AND coalesce(k.score, 0.0) >= 0.5 THEN 'A accepted' WHEN r.rank <= 10 THEN 'B rejected' ELSE 'C not retrieved' END AS status
FROM missed m LEFT JOIN ranked r ON r.source1_entity_id = m.source1_entity_id AND r.candidate_entity_id = m.candidate_entity_id LEFT JOIN scored k ON k.source1_entity_id = m.source1_entity_id AND k.candidate_entity_id = m.candidate_entity_id""",
        _MISSED, ",".join([O.fast_hits(name="fast", prefix="f"), O.united(config.RANK_WEIGHTS, "fast"), O.ranked(["support", "strength", "candidate_entity_id"], 20, False)]), O.RULE,
    ),
)
def recovery_status(spark, sf_dir):
    """Misses of the exact block, with the production ranking in the part of the second retriever."""
    q, t = _sides(spark, sf_dir)
    ranked = candidates.production_ranked(blocking.fast_hits(q, t))
    missed = forensics.misses(_truth(spark, sf_dir), blocking.research_hits(q, t, ["exact_name"]))
    return forensics.recovery(missed, ranked.withColumnRenamed("rank", "embedding_rank"), features.rule_scores(ranked, q, t), 0.5, 10).na.fill(999, ["embedding_rank"])


@query(
    "dense_recall_by_category",
    O.with_(
        _DENSE,
        "half AS (SELECT q.id AS query_id, t.id AS target_id, CAST(row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v[1:32]::DOUBLE[], t.v[1:32]::DOUBLE[]), 9) DESC, t.id) AS INTEGER) AS rank FROM e q JOIN e t ON q.id % 20 = 0 AND t.id <> q.id)",
        "pr AS (SELECT d.query_id, d.target_id, (SELECT label FROM e WHERE id = d.query_id) AS category, t.rank AS r1, o.rank AS r2 FROM d LEFT JOIN top t ON t.query_id = d.query_id AND t.target_id = d.target_id LEFT JOIN half o ON o.query_id = d.query_id AND o.target_id = d.target_id AND o.rank <= 200 WHERE d.same)",
        select="\nSELECT category, k, count(*) AS n, avg(CAST(coalesce(r1 <= k, false) AS INTEGER)) AS first_recall, avg(CAST(coalesce(r2 <= k, false) AS INTEGER)) AS second_recall, avg(CAST(coalesce(r1 <= k, false) OR coalesce(r2 <= k, false) AS INTEGER)) AS union_recall FROM pr CROSS JOIN (VALUES (10), (25), (50), (100), (200)) AS x(k) GROUP BY 1, 2",
    ),
    ["first_recall", "second_recall", "union_recall"],
)
def dense_recall_by_category(spark, sf_dir):
    """A ranking by all dimensions and one by the first half of them."""
    q, t = _vectors(spark, sf_dir)
    relevant = _same_label(q, t).withColumnRenamed("label", "category")
    first, second = dense.top_k(q, t, 200), dense.top_k(*(x.withColumn("v", F.slice("v", 1, 32)) for x in (q, t)), 200)
    both = relevant.join(first.select("query_id", "target_id", F.col("rank").alias("first_rank")), ["query_id", "target_id"], "left")
    return dense.recall_by_category(both.join(second.select("query_id", "target_id", F.col("rank").alias("second_rank")), ["query_id", "target_id"], "left"), [10, 25, 50, 100, 200])


@query("hybrid_features")
def hybrid_features(spark, sf_dir):
    """Names and joint texts as hashed 3-gram vectors, their cosines, and the eight hybrid features."""
    q, t = _sides(spark, sf_dir)
    side = lambda df, key: dense.encoded(dense.encoded(df.select(F.col("entity_id").alias(key), "name_norm", X.name_and_address(F.col("name_norm"), F.col("address_norm")).alias("joint")), "name_norm").withColumnRenamed("v", f"{key}_n"), "joint").withColumnRenamed("v", f"{key}_j").select(key, f"{key}_n", f"{key}_j")
    dot = lambda c: F.aggregate(F.zip_with(f"source1_entity_id_{c}", f"candidate_entity_id_{c}", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    pairs = features.base_features(features.with_records(candidates.production_ranked(blocking.fast_hits(q, t)), q, t))
    pairs = pairs.join(side(q, "source1_entity_id"), "source1_entity_id").join(side(t, "candidate_entity_id"), "candidate_entity_id")
    pairs = pairs.withColumn("name_cosine", dot("n")).withColumn("joint_cosine", dot("j")).withColumn("embedding_rank", F.when(F.col("joint_cosine") >= 0.5, F.col("rank")))
    return features.hybrid_features(pairs).select(*PAIR, *features.HYBRID)


# --- trained model and whole plans ---------------------------------------------------------------------------------
def _training(spark, sf_dir):
    return forensics.labelled(features.base_features(_featured(spark, sf_dir)), _truth(spark, sf_dir)).select(*PAIR, "label", *features.FEATURES)


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    """Trained on the train side of group_split(), scored on all pairs."""
    pairs = _training(spark, sf_dir).persist()
    part = forensics.group_split(_spine(spark, sf_dir))
    fitted = model.train(pairs.join(part.where("part = 'train'"), "source1_entity_id", "left_semi"), rounds=10)
    return model.scored(fitted, pairs).select(*PAIR, "label", "score")


@query("resolve_texts")
def resolve_texts(spark, sf_dir):
    """The whole resolver on free text with accents: matches of every query."""
    t = entities.texts(spark, sf_dir)
    return R.resolve(t.where("entity_id like 'S1-%'"), t.where("entity_id not like 'S1-%'"))[0]


@query("resolve_businesses", ORACLES["submission_rows"])
def resolve_businesses(spark, sf_dir):
    """The whole resolver from raw tables."""
    b = entities.businesses(spark, sf_dir)
    return R.resolve(b.where("entity_id like 'S1-%'"), b.where("entity_id not like 'S1-%'"), unicode=False)[0]
