"""Normalisation of names and addresses as Column expressions.

Only Unicode normal forms have no built-in counterpart. They are Arrow functions that get the rows with characters
beyond ASCII; for all others they get null, and lower() and trim() do.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..session import ship_package

_ASCII = r"^[\x00-\x7F]*$"
#: A word's end or begin where letters, digits and the low line make up words.
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower().strip())


@F.pandas_udf(T.StringType())
def _unaccented(texts: pd.Series) -> pd.Series:
    def bare(t):
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    return texts.map(lambda t: None if t is None else bare(t))


def _beyond_ascii(text: Column) -> Column:
    return F.when(~text.rlike(_ASCII), text)


def folded(text: Column, unicode: bool = True) -> Column:
    """NFKC, lower case, trimmed; null gives ''. unicode=False leaves NFKC out, for text known to be in that form."""
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    return F.coalesce(_nfkc(_beyond_ascii(text)), plain) if unicode else plain


def unaccented(text: Column, unicode: bool = True) -> Column:
    """Without marks that combine with letters."""
    return F.coalesce(_unaccented(_beyond_ascii(text)), text) if unicode else text


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _worded(text: Column, unicode: bool) -> Column:
    text = F.regexp_replace(folded(text, unicode), "&+", " and ")
    text = F.regexp_replace(text, "['’`´]", "")
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_norm(name: Column, unicode: bool = True) -> Column:
    """Lower-case words, '&' as 'and', without apostrophes and punctuation."""
    return _collapsed(_worded(name, unicode))


def name_core(norm: Column, suffixes: list[str] | None = None) -> Column:
    """Without one legal suffix, unless less than two characters would be left."""
    words = sorted(config.LEGAL_SUFFIXES if suffixes is None else suffixes, key=len, reverse=True)
    bare = F.trim(F.regexp_replace(norm, rf"(?:\s+|^)(?:{'|'.join(words)})\s*$", ""))
    return F.when(F.length(bare) < 2, norm).otherwise(bare)


def alnum(norm: Column, unicode: bool = True) -> Column:
    """ASCII letters and digits, accents taken off."""
    return _collapsed(F.regexp_replace(unaccented(norm, unicode), r"[^a-z0-9\s]", " "))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens(text))), " ")


def char_3grams(text: Column) -> Column:
    """All 3-grams of the text between two blanks on either side, joined by a blank."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(text == "", "").otherwise(F.array_join(grams, " "))


def address_norm(address: Column, words: dict[str, str] | None = None, unicode: bool = True) -> Column:
    """As name_norm(), with words in their standard form."""
    table = config.ADDRESS_WORDS if words is None else words
    standard = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(tokens(_worded(address, unicode)), lambda t: F.coalesce(F.try_element_at(standard, t), t)), " ")


def postal_code(address: Column) -> Column:
    """The last nine-digit code, else the last six-digit code, else the last token of five digits, else ''."""
    # The three patterns.
    a = F.coalesce(address, F.lit(""))
    last = lambda p: F.try_element_at(F.regexp_extract_all(a, F.lit(p), F.lit(0)), F.lit(-1))
    bare = F.transform(tokens(a), lambda t: F.regexp_replace(t, "^[ ,.#-]+|[ ,.#-]+$", ""))
    five = F.try_element_at(F.filter(bare, lambda t: t.rlike(r"^\p{Nd}{5}$")), F.lit(-1))
    return F.coalesce(last(rf"{_B}\p{{Nd}}{{5}}-\p{{Nd}}{{4}}{_E}"), last(rf"{_B}[1-9]\p{{Nd}}{{5}}{_E}"), five, F.lit(""))


# Patterns of house numbers, in the order in which they are tried.
_HOUSE = [
    rf"(?i){_B}(?:no|door\s*no|plot|flat|tower|block|house\s*no|bldg\s*no)[\s.:#-]*([0-9]+[a-z]?(?:[-/][0-9a-z]+)?){_E}",
    rf"(?i){_B}([0-9]+(?:\s*(?:bis|ter))?)\s+(?:rue|avenue|av|boulevard|bd|chemin|all|impasse){_E}",
    rf"(?i){_B}([0-9]+[a-z]?(?:[-/][0-9]+[a-z]?)?)\s+(?:[a-z]+\s+)?(?:street|st|road|rd|avenue|ave|drive|dr|boulevard|blvd|lane|ln|way){_E}",
    rf"(?i)^\s*([0-9]+[a-z]?(?:[-/][0-9a-z]+)?){_E}",
]


def house_number(address: Column) -> Column:
    """The number after an explicit marker, else before a French way, else before a street, else at the begin, else ''."""
    a = F.coalesce(address, F.lit(""))
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(a, p, 1)), F.lit("")) for p in _HOUSE], F.lit(""))


def number_tokens(address: Column) -> Column:
    a = F.coalesce(address, F.lit(""))
    return F.array_join(F.regexp_extract_all(a, F.lit(rf"{_B}\p{{Nd}}+[a-zA-Z]?(?:[-/]\p{{Nd}}+[a-zA-Z]?)?{_E}"), F.lit(0)), " ")


def web_tokens(name: Column, unicode: bool = True) -> Column:
    """Words of a name or web address without web endings and legal words."""
    text = F.regexp_replace(folded(name, unicode), r"[./\-_&]", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    drop = F.array(*[F.lit(w) for w in [*config.WEB_ENDINGS, *config.LEGAL_STOPWORDS]])
    return F.filter(tokens(text), lambda t: ~F.array_contains(drop, t))


def name_web(name: Column, unicode: bool = True) -> Column:
    return F.array_join(web_tokens(name, unicode), " ")


def name_web_collapsed(name: Column, unicode: bool = True) -> Column:
    return F.array_join(web_tokens(name, unicode), "")


def name_core_v2(core: Column) -> Column:
    """Without one leading article or prefix."""
    words = tokens(core)
    lead = F.try_element_at(words, F.lit(1)).isin(config.LEADING_WORDS)
    return F.array_join(F.when(lead, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words), " ")


def source_of(entity_id: Column) -> Column:
    """source1, source2 or source3 by the prefix of the id, else unknown."""
    prefix = F.element_at(F.split(entity_id, "-"), 1)
    return F.when(prefix.isin("S1", "S2", "S3"), F.concat(F.lit("source"), F.substring(prefix, 2, 1))).otherwise("unknown")


def script(text: Column) -> Column:
    """The script of the first character of an Indic range, else Latin."""
    ranges = "".join(f"\\u{at:04X}-\\u{at + 127:04X}" for at in config.SCRIPTS)
    first = F.ascii(F.regexp_extract(text, f"[{ranges}]", 0))
    found = None
    for at, label in config.SCRIPTS.items():
        test = first.between(at, at + 127)
        found = F.when(test, label) if found is None else found.when(test, label)
    return found.otherwise("Latin")


def name_and_address(name: Column, address: Column) -> Column:
    return F.when(F.trim(address) == "", F.trim(name)).otherwise(F.concat_ws(" | ", F.trim(name), F.trim(address)))


def initials(text: Column) -> Column:
    return F.array_join(F.transform(tokens(text), lambda t: F.left(t, F.lit(1))), "")


def normalized(df, unicode: bool = True):
    """df (entity_id, business_name, business_address, country, ...) with all derived columns, empty for missing values."""
    if unicode:
        ship_package(df.sparkSession)
    name, address = F.col("business_name"), F.col("business_address")
    df = df.select(
        "*",
        name_norm(name, unicode).alias("name_norm"),
        address_norm(address, unicode=unicode).alias("address_norm"),
        F.lower(F.trim(F.coalesce("country", F.lit("")))).alias("country_norm"),
        name_web_collapsed(name, unicode).alias("name_web_collapsed"),
        postal_code(address).alias("postal_code"),
        house_number(address).alias("house_number"),
        number_tokens(address).alias("address_number_tokens"),
    )
    df = df.select(
        "*",
        name_core(F.col("name_norm")).alias("name_core"),
        alnum(F.col("name_norm"), unicode).alias("name_alnum"),
        alnum(F.col("address_norm"), unicode).alias("address_alnum"),
        sorted_tokens(F.col("name_norm")).alias("name_sorted_tokens"),
        sorted_tokens(F.col("address_norm")).alias("address_sorted_tokens"),
        tokens(F.col("name_norm")).alias("name_tokens"),
        tokens(F.col("address_norm")).alias("address_tokens"),
    )
    return df.select("*", char_3grams(F.col("name_alnum")).alias("name_char_3gram"), name_core_v2(F.col("name_core")).alias("name_core_v2"))
