import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, run int, digest string, rep long, h string, m int"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns named like inner ones."""
    long_text = " ".join(f"word{i % 977} and the" for i in range(20_000))
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood"
    rows = [
        (1, base, "en"), (2, base + " ", "en"), (3, base, "en"), (3, base, "en"), (4, None, "en"), (5, "", None), (6, " \t\n", "fr"), (7, long_text, "en"), (8, long_text + " end", "en"),
        (9, "a\nb\nc", None), (10, "123 456 +1 (555) 010-9999 4111 1111 1111 1111", "de"), (11, "éèà çà va où être là\n" * 5, "fr"), (12, "日本語 \U0001f642 text", "en"), (None, base + " again", "en"),
        (14, "no", "en"), (15, "le chat est dans la maison avec le chien et la souris", "fr"), (16, "der hund ist in dem haus mit der katze und dem kind", "de"), (17, "AAAA" * 2000, "en"),
        (18, "\n" * 50, "en"), (19, "mail me at x.y@example.org or 10.0.0.256 or 10.0.0.25", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, None if i and i % 3 == 0 else "s1", None, "x", 1, "d", 2, "h", 3) for i, t, lang in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def folder(tmp_path_factory, spark, edge):
    """The edge rows as a documents table, with labels."""
    at = tmp_path_factory.mktemp("edge")
    edge.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (7, 1, 0), (15, 1, 0), (9, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)
