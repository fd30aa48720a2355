import pytest

from paraforge.llm.common import Workspace


@pytest.fixture
def ws(spark):
    return Workspace(spark, "test")


SCHEMA = "doc_id long, text string, source string, bucket int, n long"


@pytest.fixture
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and texts, and columns that clash with the operators' own."""
    line = "this line of plain words stands in many of the documents here"
    long = " ".join(f"word{i % 997} of{i}" for i in range(20_000))
    rows = [
        (0, "The quick brown fox jumps over the lazy dog, and runs away into the dark green woods again and again today.", "a", 1, 1),
        (1, "The quick brown fox jumps over the lazy dog, and runs away into the dark green woods again and again today.", "a", 1, 1),
        (2, "the Quick brown fox jumps over the lazy dog, and runs away into the dark green woods again and again now.", None, 2, 1),
        (3, None, "b", None, None),
        (4, "", "b", 0, 0),
        (5, " \t\n\x0b\x0c\r ", None, 0, 0),
        (6, long, "b", 3, 3),
        (7, "one", "c", 3, 3),
        (7, "one", "c", 3, 3),
        (8, f"{line}\nUnlike its neighbours it tells of snowmen ☃ and of \U0001f642 in words that no other text has at all, not even one.", "c", 4, 4),
        (9, f"Mail bob@example.com or call +1 (415) 555-2671 from 10.0.0.1 with 4111 1111 1111 1111.\n{line}", "c", 5, 5),
        (None, "No id but words enough to be counted among the others in the table of documents that this test has made up for it.", "d", 6, 6),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
