"""Independent statements of the resolver in DuckDB's SQL, for the queries in queries.py."""

from __future__ import annotations

import re

from .. import config


def quoted(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _norm(x: str) -> str:
    out = f"regexp_replace(lower(trim({x})), '&+', ' and ', 'g')"
    out = f"regexp_replace({out}, '[''’`´]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _web(x: str) -> str:
    text = f"regexp_replace(lower(trim({x})), '[./\\-_&]', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
    return f"list_filter(string_split({text}, ' '), lambda t: t <> '' AND t NOT IN {quoted([*config.WEB_ENDINGS, *config.LEGAL_STOPWORDS])})"


def _grams(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '' ELSE array_to_string(list_transform(range(1, length({x}) + 3), lambda i: substr('  ' || {x} || '  ', i, 3)), ' ') END"


_SUFFIX = "|".join(sorted(config.LEGAL_SUFFIXES, key=len, reverse=True))
_ABBREVIATED = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in config.ADDRESS_WORDS.items()) + " ELSE t END"
_A = "coalesce(business_address, '')"
# Patterns of house numbers, in the order in which they are tried.
HOUSE = [
    r"(?i)\b(?:no|door\s*no|plot|flat|tower|block|house\s*no|bldg\s*no)[\s.:#-]*([0-9]+[a-z]?(?:[-/][0-9a-z]+)?)\b",
    r"(?i)\b([0-9]+(?:\s*(?:bis|ter))?)\s+(?:rue|avenue|av|boulevard|bd|chemin|all|impasse)\b",
    r"(?i)\b([0-9]+[a-z]?(?:[-/][0-9]+[a-z]?)?)\s+(?:[a-z]+\s+)?(?:street|st|road|rd|avenue|ave|drive|dr|boulevard|blvd|lane|ln|way)\b",
    r"(?i)^\s*([0-9]+[a-z]?(?:[-/][0-9a-z]+)?)\b",
]
BUSINESSES = """
ev AS (
  SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id,
         p_name || ' ' || CASE p_partkey % 5 WHEN 0 THEN 'Inc.' WHEN 1 THEN 'LLC' WHEN 2 THEN 'Private Limited' WHEN 3 THEN '& Co' ELSE '' END AS business_name,
         p_size || ' ' || p_type || ' Street, ' || (10000 + p_size * 101) AS business_address,
         CASE p_size % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
  FROM part
)"""
TEXTS = """
ev AS (
  SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, array_to_string(w[1:6], ' ') AS business_name, array_to_string(w[7:14], ' ') AS business_address, lang AS country
  FROM (SELECT doc_id, lang, string_split_regex(trim(coalesce(text, '')), '\\s+') AS w FROM documents)
)"""
TRUTH = """
truth AS (
  SELECT 'S1-' || a.p_partkey AS source1_entity_id, 'S' || (b.p_partkey % 3 + 1) || '-' || b.p_partkey AS target_id
  FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size WHERE a.p_partkey % 3 = 0 AND b.p_partkey % 3 <> 0
), spine AS (SELECT entity_id AS source1_entity_id FROM ev WHERE entity_id LIKE 'S1-%')"""
NORMALIZED = f"""
n1 AS (
  SELECT *, {_norm('business_name')} AS name_norm, array_to_string(list_transform({_tokens(_norm(_A))}, lambda t: {_ABBREVIATED}), ' ') AS address_norm,
         lower(trim(coalesce(country, ''))) AS country_norm, array_to_string({_web('business_name')}, '') AS name_web_collapsed,
         coalesce(regexp_extract_all({_A}, '\\b[0-9]{{5}}-[0-9]{{4}}\\b')[-1], regexp_extract_all({_A}, '\\b[1-9][0-9]{{5}}\\b')[-1],
                  list_filter(list_transform(string_split_regex({_A}, '\\s+'), lambda t: regexp_replace(t, '^[ ,.#-]+|[ ,.#-]+$', '', 'g')), lambda t: regexp_matches(t, '^[0-9]{{5}}$'))[-1], '') AS postal_code,
         coalesce({', '.join(f"nullif(trim(regexp_extract({_A}, '{p}', 1)), '')" for p in HOUSE)}, '') AS house_number,
         array_to_string(regexp_extract_all({_A}, '\\b[0-9]+[a-zA-Z]?(?:[-/][0-9]+[a-zA-Z]?)?\\b'), ' ') AS address_number_tokens
  FROM ev
), n2 AS (
  SELECT *, CASE WHEN length(trim(regexp_replace(name_norm, '(?:\\s+|^)(?:{_SUFFIX})\\s*$', ''))) < 2 THEN name_norm ELSE trim(regexp_replace(name_norm, '(?:\\s+|^)(?:{_SUFFIX})\\s*$', '')) END AS name_core,
         trim(regexp_replace(regexp_replace(name_norm, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name_alnum,
         trim(regexp_replace(regexp_replace(address_norm, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS address_alnum,
         {_tokens('name_norm')} AS name_tokens, {_tokens('address_norm')} AS address_tokens
  FROM n1
), nm AS (
  SELECT *, array_to_string(list_sort(list_distinct(name_tokens)), ' ') AS name_sorted_tokens, array_to_string(list_sort(list_distinct(address_tokens)), ' ') AS address_sorted_tokens,
         {_grams('name_alnum')} AS name_char_3gram,
         array_to_string(CASE WHEN {_tokens('name_core')}[1] IN {quoted(config.LEADING_WORDS)} THEN {_tokens('name_core')}[2:] ELSE {_tokens('name_core')} END, ' ') AS name_core_v2,
         substr(entity_id, 1, 2) AS source
  FROM n2
)"""

_T3 = "list_filter(name_tokens, lambda t: length(t) >= 3)"
_PLAIN = f"list_filter({_T3}, lambda t: t NOT IN {quoted(config.LEGAL_STOPWORDS)})"
_GRAMS = _tokens("name_char_3gram")
_W4 = "list_filter(address_tokens, lambda t: length(t) >= 4 AND NOT regexp_matches(t, '^[0-9]+$'))"


def _one(c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN [{c}] ELSE [] END"


def _first(part: str, sep: str, words: str) -> str:
    return f"CASE WHEN {part} <> '' AND len({words}) > 0 THEN [{part} || '{sep}' || ({words})[1]] ELSE [] END"


def _housed(words: str, prefix: str = "") -> str:
    return f"CASE WHEN house_number <> '' THEN list_transform({words}, lambda t: '{prefix}' || house_number || '_' || t) ELSE [] END"


_HOUSE_TOKENS = f"list_concat({_housed(f'({_PLAIN})[1:4]')}, {_housed(f'({_W4})[1:2]', 'addr_')})"
# The limits of the research blocks. name: (index, target keys, query keys, least length, ratio, registered, cap, limit, counted)
BLOCKS = {
    "exact_name": ("exact_name", _one("name_norm"), _one("name_norm"), 2, 0.01, False, 1000, None, False),
    "name_core": ("name_core", _one("name_core"), _one("name_core"), 2, 0.01, False, 1000, None, False),
    "name_token": ("name_token", f"list_distinct({_T3})", _T3, 3, 0.005, False, 500, "50", False),
    "rare_token": ("name_token", f"list_distinct({_T3})", _T3, 3, 0.005, False, 500, "50", False),
    **{f"char_3gram_k{k}": ("char_3gram", f"list_distinct({_GRAMS})", f"list_distinct({_GRAMS})", 3, 0.05, False, 1000, str(k), True) for k in (5, 10, 20, 50)},
    "postal": ("postal", _one("postal_code"), _one("postal_code"), 4, 0.01, False, 500, "50", False),
    "house_name": ("house_name", _first("house_number", "#", _T3), _first("house_number", "#", _T3), 2, 0.01, False, 200, "50", False),
    "address_token": ("address_token", f"list_distinct({_W4})", _W4, 4, 0.002, False, 300, "30", False),
    "combined_postal_name": ("combined_postal_name", _first("postal_code", "#", _T3), _first("postal_code", "#", _T3), 2, 0.01, False, 200, "50", False),
    "name_web_norm": ("name_web_norm", _one("name_web_collapsed"), "CASE WHEN length(name_web_collapsed) >= 4 THEN [name_web_collapsed] ELSE [] END", 2, 0.005, True, 500, "50", False),
    "name_core_v2": ("name_core_v2", _one("name_core_v2"), _one("name_core_v2"), 2, 0.005, True, 500, "50", False),
    "house_token": ("house_token", _HOUSE_TOKENS, _HOUSE_TOKENS, 2, 0.005, True, 500, "50", False),
    "char_3gram_adaptive": ("char_3gram", f"list_distinct({_GRAMS})", f"list_distinct({_GRAMS})", 3, 0.05, False, 1000, "CASE WHEN length(name_norm) >= 8 THEN 35 ELSE 10 END", True),
}


def postings(names: list[str], name: str = "post") -> str:
    """CTEs up to the pruned and capped postings of the blocks' indexes."""
    index = {BLOCKS[n][0]: BLOCKS[n] for n in names}
    filed = " UNION ALL ".join(f"SELECT entity_id, source, country_norm AS country, '{i}' AS block, unnest({b[1]}) AS key FROM nm WHERE source <> 'S1' AND country_norm <> ''" for i, b in index.items())
    limits = ", ".join(f"('{i}', {b[3]}, {b[4]}, {str(b[5]).lower()}, {b[6]})" for i, b in index.items())
    return f"""
lim AS (SELECT * FROM (VALUES {limits}) AS v(block, least, ratio, registered, cap)),
filed AS (SELECT f.* FROM ({filed}) f JOIN lim USING (block) WHERE length(key) >= least),
lens AS (SELECT source, country, block, key, count(*) AS n FROM filed GROUP BY ALL),
dfs AS (SELECT source, block, key, sum(n) AS df FROM lens GROUP BY ALL),
pool AS (SELECT source, count(*) AS pool FROM nm WHERE source <> 'S1' GROUP BY 1),
reg AS (SELECT source, block, count(DISTINCT entity_id) AS reg FROM filed GROUP BY ALL),
{name} AS (
  SELECT entity_id, source, country, block, key, CAST(df AS BIGINT) AS df FROM (
    SELECT f.*, d.df, row_number() OVER (PARTITION BY f.source, f.country, f.block, f.key ORDER BY f.entity_id) AS r, cap
    FROM filed f JOIN lens l USING (source, country, block, key) JOIN dfs d USING (source, block, key) JOIN lim USING (block) JOIN pool USING (source) JOIN reg USING (source, block)
    WHERE l.n <= greatest(1, floor(ratio * CASE WHEN registered THEN reg ELSE pool END))) WHERE r <= cap
)"""


def hits(names: list[str], name: str = "hits") -> str:
    """CTEs up to source1_entity_id, candidate_entity_id, source, block, place."""
    asked = []
    for n in names:
        index, _, keys, *_, limit, counted = BLOCKS[n]
        base = f"SELECT entity_id AS q, country_norm AS country, unnest({keys}) AS key, unnest(range(len({keys}))) AS pos, {limit or 'NULL'} AS most FROM nm WHERE source = 'S1' AND country_norm <> ''"
        if n == "rare_token":
            base = f"""SELECT q, country, key, r AS pos, most, source FROM (
  SELECT a.*, s.source, row_number() OVER (PARTITION BY a.q, s.source ORDER BY coalesce(d.df, 999999), a.pos) AS r
  FROM ({base}) a CROSS JOIN (SELECT source FROM pool) s LEFT JOIN dfs d ON d.source = s.source AND d.block = 'name_token' AND d.key = a.key) WHERE r <= 2"""
        else:
            base = f"SELECT *, NULL AS source FROM ({base})"
        asked.append(f"SELECT q, country, '{n}' AS block, '{index}' AS idx, key, pos, CAST(most AS INTEGER) AS most, {str(counted).lower()} AS counted, CAST(source AS VARCHAR) AS only FROM ({base})")
    return (
        postings(names)
        + f""",
asked AS ({' UNION ALL '.join(asked)}),
{name} AS (
  SELECT source1_entity_id, candidate_entity_id, source, block, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY source1_entity_id, source, block ORDER BY CASE WHEN counted THEN -shared ELSE pos END, candidate_entity_id) AS place FROM (
      SELECT a.q AS source1_entity_id, p.entity_id AS candidate_entity_id, p.source, a.block, min(a.pos) AS pos, count(*) AS shared, max(a.most) AS most, any_value(a.counted) AS counted
      FROM asked a JOIN post p ON p.country = a.country AND p.block = a.idx AND p.key = a.key AND (a.only IS NULL OR a.only = p.source) GROUP BY 1, 2, 3, 4))
  WHERE most IS NULL OR place <= most
)"""
    )


# The limits of the fast blocks. name: (target keys, query keys, least length, cap, limit)
_WEB_OF_NORM = f"CASE WHEN len({_web('name_norm')}) > 0 THEN [array_to_string({_web('name_norm')}, '')] ELSE [] END"
_P3 = _housed(f"({_PLAIN})[1:3]")
FAST = {
    "exact_name": (_one("name_norm"), _one("name_norm"), 2, 500, 50),
    "name_core": (_one("name_core"), _one("name_core"), 2, 500, 50),
    "rare_token": (f"({_PLAIN})[1:3]", f"({_PLAIN})[1:2]", 3, 200, 40),
    "char_3gram_k10": (f"({_GRAMS})[1:5]", f"({_GRAMS})[1:4]", 3, 100, 10),
    "house_name": (_P3, _P3, 2, 100, 30),
    "combined_postal_name": (_first("postal_code", "_", _PLAIN), _first("postal_code", "_", _PLAIN), 2, 100, 30),
    "address_token": ("list_filter(address_tokens[1:2], lambda t: length(t) >= 4 AND NOT regexp_matches(t, '^[0-9]+$'))", f"({_W4})[1:2]", 4, 150, 30),
    "name_web_norm": (_WEB_OF_NORM, _one("name_web_collapsed"), 4, 200, 40),
    "house_token": (_P3, _P3, 3, 150, 30),
}


def fast_hits(names: list[str] | None = None, name: str = "hits", prefix: str = "") -> str:
    """CTEs up to the fast blocks' pairs; prefix: of the inner tables, where hits() stands beside."""
    names = names or list(FAST)
    limits = ", ".join(f"('{n}', {FAST[n][2]}, {FAST[n][3]}, {FAST[n][4]})" for n in names)
    keys = lambda n, i: f"SELECT entity_id, source, country_norm AS country, '{n}' AS block, unnest({FAST[n][i]}) AS key, unnest(range(len({FAST[n][i]}))) AS pos FROM nm WHERE country_norm <> ''"
    return f"""
{prefix}lim AS (SELECT * FROM (VALUES {limits}) AS v(block, least, cap, most)),
{prefix}filed AS (SELECT * FROM (SELECT f.*, cap, row_number() OVER (PARTITION BY source, country, block, key ORDER BY entity_id, pos) AS r FROM ({' UNION ALL '.join(keys(n, 0) for n in names)}) f JOIN {prefix}lim lim USING (block) WHERE source <> 'S1' AND length(key) >= least) WHERE r <= cap),
{prefix}asked AS (SELECT * FROM ({' UNION ALL '.join(keys(n, 1) for n in names)}) WHERE source = 'S1'),
{name} AS (
  SELECT DISTINCT source1_entity_id, candidate_entity_id, source, block FROM (
    SELECT a.entity_id AS source1_entity_id, f.entity_id AS candidate_entity_id, f.source, a.block, row_number() OVER (PARTITION BY a.entity_id, f.source, a.block ORDER BY a.pos, f.r) AS place, most
    FROM {prefix}asked a JOIN {prefix}filed f ON f.country = a.country AND f.block = a.block AND f.key = a.key JOIN {prefix}lim lim ON lim.block = a.block) WHERE place <= most
)"""


def weights(table: dict[str, float]) -> str:
    return "CASE block " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1.0 END"


def united(table: dict[str, float], source: str = "hits", name: str = "pairs") -> str:
    return f"""
{name} AS (
  SELECT source1_entity_id, candidate_entity_id, source, list_sort(list(DISTINCT block)) AS blocks, count(*) AS support, CAST(sum(w) AS DOUBLE) AS strength, CAST(max(w) AS DOUBLE) AS top,
         max(struct_pack(w := w, block := block)).block AS best_block
  FROM (SELECT *, CAST({weights(table)} AS DOUBLE) AS w FROM {source}) GROUP BY 1, 2, 3
)"""


def ranked(order: list[str], budget: int, per_source: bool, source: str = "pairs", name: str = "ranked") -> str:
    by = "source1_entity_id" + (", source" if per_source else "")
    return f"{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {', '.join(c + ' DESC' for c in order)}) AS INTEGER) AS rank FROM {source}) WHERE rank <= {budget})"


PRODUCTION = ",".join([fast_hits(), united(config.RANK_WEIGHTS), ranked(["support", "strength", "candidate_entity_id"], 20, False)])


def lev(x: str, y: str) -> str:
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0 ELSE 1.0 - CAST(levenshtein({x}, {y}) AS DOUBLE) / greatest(length({x}), length({y})) END"


def jaccard(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len(list_distinct(list_concat({x}, {y}))) END"


def overlap(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / least(len(list_distinct({x})), len(list_distinct({y}))) END"


RULE = f"scored AS (SELECT r.source1_entity_id, r.candidate_entity_id, r.source, r.blocks, r.support, r.rank, round(({lev('a.name_norm', 'b.name_norm')}) * ({lev('a.address_norm', 'b.address_norm')}), 6) AS score FROM ranked r JOIN nm a ON a.entity_id = r.source1_entity_id JOIN nm b ON b.entity_id = r.candidate_entity_id)"


#: Tables that several parts of a statement read: computed once.
_SHARED = re.compile(r"\b(ev|nm|truth|hits|fast|pairs|ranked|scored|missed) AS \(")


def with_(*ctes: str, select: str) -> str:
    return "WITH " + _SHARED.sub(r"\1 AS MATERIALIZED (", ",".join(ctes)) + "\n" + select


def scored(select: str) -> str:
    """select over ev, nm, truth, spine, ranked (production) and scored."""
    return with_(BUSINESSES, NORMALIZED, TRUTH, PRODUCTION, RULE, select=select)


def over_hits(names: list[str], select: str, *more: str) -> str:
    return with_(BUSINESSES, NORMALIZED, TRUTH, hits(names), *more, select=select)


def rounded(columns: list[str], sql: str, digits: int = 6) -> str:
    """The columns of a statement rounded, as queries.py rounds its averages and ratios."""
    at = sql.rfind("\nSELECT ")
    return f"{sql[:at]}\nSELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({sql[at + 1 :]})"


def per_query(pairs: str, name: str = "per", by: str = "") -> str:
    """n_true, n_pred, tp of every query (and threshold)."""
    grid = f", {by}" if by else ""
    spine = f"(SELECT * FROM spine CROSS JOIN grid)" if by else "spine"
    on = f"USING (source1_entity_id{grid})"
    return f"""
{name} AS (
  SELECT s.source1_entity_id{', s.' + by if by else ''}, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
  FROM {spine} s
  LEFT JOIN (SELECT source1_entity_id{grid}, count(*) AS n_pred, count(target_id) AS tp FROM (SELECT DISTINCT source1_entity_id, candidate_entity_id{grid} FROM {pairs}) p
             LEFT JOIN (SELECT DISTINCT source1_entity_id AS q, target_id FROM truth) t ON q = source1_entity_id AND target_id = candidate_entity_id GROUP BY ALL) p {on}
  LEFT JOIN (SELECT source1_entity_id, count(DISTINCT target_id) AS n_true FROM truth GROUP BY 1) t ON t.source1_entity_id = s.source1_entity_id
)"""


F05 = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"
RATES = ["macro_f05", "macro_precision", "macro_recall", "micro_precision", "micro_recall", "singleton_exact_empty_acc", "singleton_false_match_rate", "single_match_s1_accuracy", "multi_match_s1_accuracy"]
_EXACT = "n_true = n_pred AND n_true = tp"
DECISION = f"""coalesce(avg({F05}), 0.0) AS macro_f05, coalesce(avg(CASE WHEN n_pred > 0 THEN tp / n_pred WHEN n_true = 0 THEN 1.0 ELSE 0.0 END), 0.0) AS macro_precision,
coalesce(avg(CASE WHEN n_true > 0 THEN tp / n_true WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END), 0.0) AS macro_recall,
coalesce(sum(tp) / nullif(sum(n_pred), 0), 0.0) AS micro_precision, coalesce(sum(tp) / nullif(sum(n_true), 0), 0.0) AS micro_recall,
CAST(sum(n_pred) AS BIGINT) AS total_predicted_matches, CAST(sum(n_true) AS BIGINT) AS total_true_matches, CAST(sum(tp) AS BIGINT) AS total_true_positives,
CAST(sum(n_pred - tp) AS BIGINT) AS false_merges_count, CAST(sum(n_true - tp) AS BIGINT) AS missed_true_pairs_count, count(*) FILTER (n_true = 0) AS singleton_count,
coalesce(count(*) FILTER (n_true = 0 AND n_pred = 0) / nullif(count(*) FILTER (n_true = 0), 0), 1.0) AS singleton_exact_empty_acc,
coalesce(count(*) FILTER (n_true = 0 AND n_pred > 0) / nullif(count(*) FILTER (n_true = 0), 0), 0.0) AS singleton_false_match_rate,
coalesce(count(*) FILTER (n_true = 1 AND {_EXACT}) / nullif(count(*) FILTER (n_true = 1), 0), 0.0) AS single_match_s1_accuracy,
coalesce(count(*) FILTER (n_true > 1 AND {_EXACT}) / nullif(count(*) FILTER (n_true > 1), 0), 0.0) AS multi_match_s1_accuracy"""
