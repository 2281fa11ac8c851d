import pytest

from pressline.llm.common import importable
from tests.conftest import spark  # noqa: F401  (the session fixture)

SF001 = "/root/testdata/sf0.001"

LONG = "alpha beta, gamma delta epsilon zeta. " * 4000

#: nulls in every column, empty, blank and very long texts, repeated rows, ties, a foreign column
ODD = [
    (1, None, "en", "a", 0, "x"), (2, "", None, "a", 0, None), (3, " \t\n ", "en", None, 3, "x"),
    (4, "One two three.", "de", "b", None, "x"), (4, "One two three.", "de", "b", None, "x"),
    (4, "Another text with the same key.", "de", "b", 1, "x"), (None, "no key here at all", None, None, None, None),
    (5, LONG, "en", "a", len(LONG), "x"), (6, LONG + "end", "en", "a", 1, "x"), (7, "\x1c   é́ 🙂 <b>|</b>", "fr", "", 9, "x"),
    (8, "One two three.", "de", "b", 2, "y"), (9, "w" * 70_000, "en", "c", 70_000, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    importable(spark)
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):  # noqa: F811
    return spark.createDataFrame([], SCHEMA)
