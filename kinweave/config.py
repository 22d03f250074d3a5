"""Data of the resolver: word lists, weights and limits."""

from __future__ import annotations

# Legal suffixes that a company name's core leaves out.
LEGAL_SUFFIXES = [
    "private limited", "pvt limited", "pvt ltd", "pte ltd", "incorporated", "corporation", "limited liability company",
    "limited liability partnership", "sociedad anonima", "societe anonyme", "societe a responsabilite limitee",
    "enterprise unipersonnelle a responsabilite limitee", "limited", "company", "private", "corp", "inc", "ltd", "llc", "llp",
    "plc", "pvt", "pte", "sarl", "sasu", "sas", "eurl", "sci", "snc", "gie", "gmbh", "co", "sa",
]
# Standard forms of address words.
ADDRESS_WORDS = {
    "street": "st", "streets": "st", "road": "rd", "roads": "rd", "avenue": "ave", "avenues": "ave", "boulevard": "blvd",
    "bd": "blvd", "bvd": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "place": "pl", "square": "sq", "circle": "cir",
    "highway": "hwy", "parkway": "pkwy", "expressway": "expy", "terrace": "ter", "way": "way", "alley": "aly", "route": "rte",
    "chemin": "chem", "impasse": "imp", "allee": "all",
    "suite": "ste", "apartment": "apt", "building": "bldg", "floor": "fl", "room": "rm", "department": "dept", "unit": "unit",
    "number": "no",
    "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
}
# Words without meaning for a name's identity, web endings, and leading words to drop.
LEGAL_STOPWORDS = [
    "limited", "private", "pvt", "ltd", "inc", "corp", "corporation", "llc", "llp", "co", "company", "enterprises", "services",
    "industries", "group", "holdings", "trading", "retail", "solutions",
]
WEB_ENDINGS = ["com", "net", "org", "co", "in", "us", "io", "biz", "info"]
LEADING_WORDS = ["the", "a", "an", "ms", "m/s", "ta", "t/a"]
# Names of the scripts whose code points begin at these places, 128 apart, from U+0900 to U+0D7F.
SCRIPTS = {
    0x0900: "Devanagari (Hindi/Marathi)", 0x0980: "Bengali", 0x0A00: "Gurmukhi (Punjabi)", 0x0A80: "Gujarati", 0x0B00: "Odia",
    0x0B80: "Tamil", 0x0C00: "Telugu", 0x0C80: "Kannada", 0x0D00: "Malayalam",
}
# Weights of blocks, for ranking candidates (extended and base generation) and for pruning to a budget.
RANK_WEIGHTS = {
    "exact_name": 8.0, "name_core": 7.0, "name_core_v2": 6.5, "name_web_norm": 6.0, "house_name": 5.5, "house_token": 5.0,
    "combined_postal_name": 4.5, "rare_token": 3.5, "char_3gram_adaptive": 2.5, "char_3gram_k10": 2.0, "address_token": 1.0,
}
BASE_WEIGHTS = {
    "exact_name": 7.0, "name_core": 6.0, "house_name": 5.0, "combined_postal_name": 4.0, "rare_token": 3.0, "char_3gram_k10": 2.0,
    "address_token": 1.0,
}
BUDGET_WEIGHTS = BASE_WEIGHTS | {"char_3gram_k5": 2.0, "char_3gram_k20": 2.0, "name_token": 2.0, "postal": 2.0}

_BASE = ["exact_name", "name_core", "rare_token", "char_3gram_k10", "house_name", "combined_postal_name", "address_token"]
#: Named unions of blocks: base configurations a to e, extended ones a to h.
BASE_UNIONS = {"a": _BASE[:2], "b": _BASE[:3], "c": _BASE[:4], "d": _BASE[:6], "e": _BASE}
EXTENDED_UNIONS = {
    "a": [*_BASE, "name_web_norm"],
    "b": [*_BASE, "char_3gram_adaptive"],
    "c": [*_BASE, "house_token"],
    "d": [*_BASE, "name_core_v2"],
    "e": [*_BASE, "name_web_norm", "char_3gram_adaptive"],
    "f": [*_BASE, "name_web_norm", "house_token"],
    "g": [*_BASE, "char_3gram_adaptive", "house_token"],
    "h": [*_BASE, "name_web_norm", "char_3gram_adaptive", "house_token", "name_core_v2"],
}
THRESHOLD = 0.5
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]
