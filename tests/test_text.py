"""Normalisation on literal names and addresses."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import text as X

# Texts and what they become.
NAMES = [
    ("Thermal & Fils SASU", "thermal and fils sasu"), ("7-Eleven", "7 eleven"), ("McDonald's", "mcdonalds"), ("  Café  DU Monde!! ", "café du monde"), (None, ""), ("", ""),
    ("ＦＵＬＬ Width", "full width"), ("A&&B", "a and b"), ("under_score", "under_score"), ("ﬁne", "fine"),
]
CORES = [
    ("celestial memorial private limited", "celestial memorial"), ("the company", "the"), ("inc", "inc"), ("ct resource private ltd", "ct resource private"), ("znb club sarl", "znb club"),
    ("co", "co"), ("a inc", "a inc"), ("x y limited liability company", "x y"),
]
ADDRESSES = [
    ("123 Main Street, Unit 4, Dallas, TX 75201", "123 main st unit 4 dallas tx 75201", "75201", "123"),
    ("154 BD du President Wilson", "154 blvd du president wilson", "", "154"),
    ("No. 35 Brentwood Apartments, Bangalore 560001", "no 35 brentwood apartments bangalore 560001", "560001", "35"),
    ("Door No 4-4 C, Some Road", "door no 4 4 c some rd", "", "4-4"), ("Plot 12-B", "plot 12 b", "", "12-B"), ("5 bis Rue Pierre Dignac", "5 bis rue pierre dignac", "", "5 bis"),
    ("75002 Paris", "75002 paris", "75002", "75002"), ("Box 9, Reno, NV 89501-1234", "box 9 reno nv 89501 1234", "89501-1234", ""), (None, "", "", ""), ("Near 44 Elm St", "near 44 elm st", "", "44"),
]


def run(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_names(spark):
    assert [r[0] for r in run(spark, [a for a, _ in NAMES], X.name_norm(F.col("v")))] == [b for _, b in NAMES]


def test_cores(spark):
    assert [r[0] for r in run(spark, [a for a, _ in CORES], X.name_core(F.col("v")))] == [b for _, b in CORES]


def test_addresses(spark):
    got = run(spark, [a[0] for a in ADDRESSES], X.address_norm(F.col("v")), X.postal_code(F.col("v")), X.house_number(F.col("v")))
    assert got == [tuple(a[1:]) for a in ADDRESSES]


def test_parts(spark):
    assert run(spark, ["b a b"], X.sorted_tokens(F.col("v")), X.initials(F.col("v"))) == [("a b", "bab")]
    assert run(spark, ["abc", ""], X.char_3grams(F.col("v"))) == [("  a  ab abc bc  c  ",), ("",)]
    assert run(spark, ["12 A-4b/7 x9 3c"], X.number_tokens(F.col("v"))) == [("12 4b/7 3c",)]
    assert run(spark, ["santé garçon"], X.unaccented(F.col("v")), X.alnum(F.col("v"))) == [("sante garcon", "sante garcon")]


@pytest.mark.parametrize("a, b", [("fortuneprecisionhigh.com", "Fortune Precision High Inc"), ("millsle.com", "Mills Le LLC")])
def test_web(spark, a, b):
    (x,), (y,) = run(spark, [a, b], X.name_web_collapsed(F.col("v")))
    assert x == y


def test_core_v2(spark):
    assert [r[0] for r in run(spark, ["the valley coalition", "valley coalition", "the", "m/s x"], X.name_core_v2(F.col("v")))] == ["valley coalition", "valley coalition", "", "x"]


def test_scripts(spark):
    got = [r[0] for r in run(spark, ["plain", "मुंबई", "ಬೆಂಗಳೂರು", "హైదరాబాద్", "12", "x தமிழ்"], X.script(F.col("v")))]
    assert got == ["Latin", "Devanagari (Hindi/Marathi)", "Kannada", "Telugu", "Latin", "Tamil"]


def test_devanagari_words(spark):
    """Combining marks aren't part of words, as in the word class of letters, digits and the low line."""
    import re

    text = "मुंबई № ½ a_b"
    assert run(spark, [text], X.name_norm(F.col("v")))[0][0] == " ".join(re.sub(r"[^\w\s]", " ", "मुंबई no 1⁄2 a_b").split())


def test_fixed_values():
    """Some values that both the plans and their SQL read from one place, stated once more."""
    from kinweave import config

    assert config.RANK_WEIGHTS["exact_name"] == 8.0 and config.RANK_WEIGHTS["address_token"] == 1.0 and config.BASE_WEIGHTS["name_core"] == 6.0
    assert config.ADDRESS_WORDS["north"] == "n" and config.ADDRESS_WORDS["southwest"] == "sw"
    assert {"pvt", "llp", "holdings"} <= set(config.LEGAL_STOPWORDS) and "the" in config.LEADING_WORDS and "biz" in config.WEB_ENDINGS
    assert config.SCRIPTS[0x0900].startswith("Devanagari") and config.SCRIPTS[0x0B80] == "Tamil"
    assert config.THRESHOLDS == [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
    assert config.EXTENDED_UNIONS["f"][-2:] == ["name_web_norm", "house_token"] and config.THRESHOLD == 0.5
