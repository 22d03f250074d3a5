"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

All of it is one projection over the whole text, with one pass for each pattern (see spans.py). Repetitions of groups are
possessive and anchored at the start of a run: they run in linear time and without recursion on texts of any length.

The context of a span are the WINDOW code points on either side of it, up to the neighbouring match of its kind. Whole
words there that belong to the kind raise its score, words of things that only look alike lower it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .spans import spans

_LOCAL = "A-Za-z0-9._%+-"
# The base kinds in their order. The possessive and anchored forms match what the plain forms in PLAIN match.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": PATTERNS["phone"],
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
BASE = ["email", "ip", "card", "phone"]
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP = rf"^{BYTE}[.]{BYTE}[.]{BYTE}[.]{BYTE}$"
#: Score in percent of a confirmed span before its context.
SCORES = {"email": 90, "ip": 60, "card": 70, "phone": 60, "iban": 70, "ssn": 30}
#: Words that raise a score by SHIFT, and words that lower it, if they stand within WINDOW before or after the span.
CONTEXT = {
    "email": "mail|e-mail|email|contact|kontakt|courriel|correo",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|telephone|tel|call|mobile|fax|handy",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|insurance",
}
COUNTER = {
    "email": "example|sample",
    "ip": "version|release|build|section|chapter",
    "card": "order|invoice|isbn|tracking|serial|part",
    "phone": "order|invoice|isbn|version|part",
    "iban": "part|serial|model|product",
    "ssn": "part|order|invoice|serial|model",
}
WINDOW, SHIFT = 40, 30
#: Spans beyond the base kinds count from this score up; base spans always stay.
LEAST = 50


def _words(words: str) -> str:
    """A pattern that finds one of the words between characters that are no letters."""
    return rf"(?i)(^|[^\p{{L}}])({words})($|[^\p{{L}}])"


def _luhn(d: Column) -> Column:
    n = F.length(d)
    digit = lambda i: F.substring(d, n - i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    )
    return total % 10 == 0


def _mod97(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": m.rlike(IP),
        "card": F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(9, 15),
        "iban": _mod97(m),
        "ssn": ~m.rlike("^(000|666|9..)-|-00-|-0000$"),
    }[kind]


def _found(kind: str, text: Column) -> Column:
    """All confirmed spans of the kind: array of (kind, start, end, match, score)."""
    kind_type = "array<struct<kind:string,start:int,end:int,match:string,score:int>>"

    def score(x: Column) -> Column:
        near = F.concat(x["before"], F.lit("|"), x["after"])
        raised = F.lit(SCORES[kind]) + F.when(near.rlike(_words(CONTEXT[kind])), SHIFT).otherwise(0) - F.when(near.rlike(_words(COUNTER[kind])), SHIFT).otherwise(0)
        return F.greatest(F.lit(0), F.least(F.lit(100), raised))

    scored = F.transform(
        F.filter(spans(text, PATTERNS[kind], WINDOW, needs=NEEDS.get(kind, "")), lambda x: _confirmed(kind, x["match"])),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), score(x).alias("score")),
    )
    return (scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= LEAST)).cast(kind_type)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one array column for each kind, of (kind, start, end, match, score), in order of start.

    The score is in percent. Null text counts as empty. Spans of one kind don't overlap; those of different kinds may.
    Time grows with the length of a text and of its matches, however many. Null ids, repeated ids and repeated rows are
    each searched as they are; extra columns are ignored, also those named like inner ones; an empty table gives an empty
    result.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), common.whole_text(text_col).alias("__text"))
    return plain.select("doc_id", *[_found(kind, F.col("__text")).alias(kind) for kind in PATTERNS])


def _joined(kinds: list[str]) -> Column:
    return F.array_join(F.flatten(F.array(*[F.transform(F.col(k), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))) for k in kinds])), ",")


def op8_pii(spark, sf_dir):
    found = find_pii(common.documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(BASE).cast("binary"), 256).alias("base_sha256"),
        _joined(list(PATTERNS)).alias("spans"),
        F.array_join(F.flatten(F.array(*[F.transform(F.col(k), lambda x: x["score"].cast("string")) for k in PATTERNS])), ",").alias("scores"),
    )


def _oracle() -> str:
    check = {
        "email": "true",
        "ip": f"regexp_matches(m, '{IP}')",
        "card": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(list_reverse(string_split(regexp_replace(m, '[^0-9]', '', 'g'), '')), "
        "lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN CAST(c AS INT) * 2 - 9 ELSE CAST(c AS INT) * 2 END)) % 10 = 0",
        "phone": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
        "iban": "CAST(array_to_string(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), "
        "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '') AS HUGEINT) % 97 = 1",
        "ssn": "NOT regexp_matches(m, '^(000|666|9..)-|-00-|-0000$')",
    }
    parts = []
    for n, kind in enumerate(PATTERNS):
        near = f"(right(before, {WINDOW}) || '|' || left(after, {WINDOW}))"
        score = f"greatest(0, least(100, {SCORES[kind]} + CASE WHEN regexp_matches({near}, '{_words(CONTEXT[kind])}') THEN {SHIFT} ELSE 0 END - CASE WHEN regexp_matches({near}, '{_words(COUNTER[kind])}') THEN {SHIFT} ELSE 0 END))"
        least = "" if kind in BASE else f" WHERE score >= {LEAST}"
        parts.append(
            f"SELECT * FROM (SELECT doc_id, {n} AS k, '{kind}' AS kind, s, s + length(m) AS e, {score} AS score FROM (SELECT doc_id, ms[i] AS m, gaps[i] AS before, gaps[i + 1] AS after, "
            f"CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s "
            f"FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{PLAIN[kind]}') AS ms, string_split_regex(t, '{PLAIN[kind]}') AS gaps FROM d))) WHERE {check[kind]}){least}"
        )
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {count},
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s), '') AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s), '') AS scores
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""


ORACLE = _oracle()
