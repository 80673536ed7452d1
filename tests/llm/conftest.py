"""Small tables with every awkward case."""

import os

import pytest

from tidegrid.llm import shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, row long, piece long, word string, ids string, held_out boolean, digest string, kind string"
LONG = "der die das und the of and words go on\n" * 3000


@pytest.fixture(scope="session")
def checkpoint(spark):
    """The shared folder: that of the session, or a temporary one where none is set."""
    return shared.shared_dir(spark, "tests")


@pytest.fixture(scope="session")
def texts():
    prose = [f"the cat number {i} sat on mat {i * 7} and looked at the {i % 5} dogs in the old garden of the house" for i in range(30)]
    deutsch = [f"der hund nummer {i} lief durch den alten garten und das haus mit den {i % 4} katzen war leer" for i in range(30)]
    rows = [(i, t, "en" if i < 30 else "de") for i, t in enumerate(prose + deutsch)]
    rows += [(100, None, "en"), (101, "", None), (102, "   \n\t ", "de"), (103, "12 34 !!", None), (104, LONG, "en"), (105, prose[0], "en"), (None, prose[1], "de"), (None, None, None)]
    rows += [(106, "one two", "en"), (106, "one two", "en"), (107, "naïve café déjà vu 日本語 \U0001f600 'S don't ½", "fr"), (108, "x" * 30_000, "en")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 0.5, 1, 2, 3, "w", "i", True, "d", "k") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="session")
def docs(spark, texts, checkpoint):
    return frame(spark, texts)


@pytest.fixture(scope="session")
def empty(spark, checkpoint):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
