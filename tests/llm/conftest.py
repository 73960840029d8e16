import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns named like an operator's own."""
    long_text = "\n".join(f"line {i} of a very long text with words {i * 7919 % 1000}" for i in range(4000))
    rows = [
        (None, "a text without an id that is long enough to count as a line\nshort", "en", "s", 1),
        (1, None, "en", "s", 0), (2, "", None, None, None), (3, " \t\n \x0b\x0c\r", "en", None, 3),
        (4, "one", "en", "s", 3), (5, "One", "en", "s", 3), (6, "shared line of more than twenty chars\nx", "en", "s", 1),
        (7, " Shared line of more than twenty chars \ny", "en", "s", 1),
        (8, "shared line of more than twenty chars\nz\nshared line of more than twenty chars", "en", "s", 1),
        (9, "<|endoftext|> a  b\n\n c\td <|endoftext|>", "en", "s", 1), (10, "ẞ É 中文 👍🏽 \x01 \x00 ▁ x", "de", "s", 1),
        (11, long_text, "en", "s", 1), (12, long_text + " end", "en", "t", 1), (12, long_text + " end", "en", "t", 1),
    ]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).cache()
    return docs


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same with columns that bear names the operators use."""
    from pyspark.sql import functions as F

    names = ["n_words", "row", "part", "class", "_id", "_text", "_row", "gram", "kept", "label", "_c0", "mult", "n"]
    return odd_docs.withColumns({n: F.lit(f"x-{n}") for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
