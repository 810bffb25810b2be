import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, sha string, row bigint, _epoch int"

LOREM = "The quick brown fox jumps over the lazy dog while seven wizards brew odd potions near the old mill pond"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"word{i % 700} {'x' * (i % 9)}" for i in range(30_000))
    rows = [
        (5, LOREM, "en", "src1", 1, "a", "b", 1, 7),
        (3, LOREM, "en", "src1", 1, None, "b", 1, 7),
        (3, LOREM, "en", "src1", 1, None, "b", 1, 7),
        (9, LOREM.replace(" ", " \t\n"), "en", "src2", None, "a", "b", None, 7),
        (None, LOREM, None, None, None, None, None, None, None),
        (None, "ein ganz anderer Text ohne Freunde", "de", None, 3, None, None, None, None),
        (7, None, "fr", "src3", 0, "a", "b", 2, 7),
        (8, "", "fr", "src3", 0, "a", "b", 2, 7),
        (10, " \n", None, "src3", 0, "a", "b", 2, 7),
        (11, "12345 --- !!!", "en", "odd source", 0, "a", "b", 2, 7),
        (12, long_text, "en", "src1", 0, "a", "b", 2, 7),
        (13, long_text + " tail", "en", "src1", 0, "a", "b", 2, 7),
        (14, "ÄÖÜ straße Straße ÉTÉ été", "de", "src4", 0, "a", "b", 2, 7),
        (14, "another text under the same id", "en", "src4", 0, "a", "b", 2, 7),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
