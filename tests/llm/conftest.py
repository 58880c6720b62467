import pytest

from marlstone.llm.common import prepare


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


@pytest.fixture
def documents(spark):
    def made(rows):
        """Rows of (doc_id, text), with columns whose names clash with what operators add or use."""
        return spark.createDataFrame([(d, t, "x", 1, 2, 3, 4, 5) for d, t in rows], "doc_id long, text string, score string, d int, h int, found int, all int, words int")

    return made


#: Nulls, empty and blank texts, ties, repeated rows, a long text, other alphabets.
AWKWARD = [
    (1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, ""), (4, " \t\n "), (None, "no id here"), (None, None), (5, "Ünï çødé 漢字 😀 ▁ text"),
    (6, "word " * 3000), (7, "line one\nline two\r\nline three"), (8, "a"), (9, "alpha beta gamma delta"),
]


@pytest.fixture
def awkward():
    return AWKWARD
