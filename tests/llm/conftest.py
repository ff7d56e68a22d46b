import pytest

LONG = "the quick brown fox of jumps over and the lazy dog " * 4000
#: doc_id, text, lang, source: nulls, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "the cat and the dog of the house is in the town", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "de", None),
    (4, " \t\n\x0b ", None, "b"),
    (5, LONG, "en", "b"),
    (6, "the cat and the dog of the house is in the town", "en", "a"),
    (6, "the cat and the dog of the house is in the town", "en", "a"),
    (None, "der Hund und die Katze 12.34.56.78 \U0001f600 a@b.org", "de", "c"),
    (7, "1 2 3 .. !! <|endoftext|> é ́ a\x1cb\x85c d İI Σς", None, "c"),
    (8, "x", "fr", ""),
]
CLASHING = ("key", "id", "words", "size", "n_words", "_text", "sig", "digest", "component", "word", "row", "epochs", "start")


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
