import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

LONG = "word " * 30000


@pytest.fixture(scope="session")
def hostile(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns that clash with the operators' own."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "x"),
        (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "x"),
        (2, "the quick brown fox jumps over the lazy dog near the old river bank today", None),
        (3, None, "y"),
        (4, "", "y"),
        (5, LONG, None),
        (None, "a text without an id that is long enough to have shingles", "z"),
        (None, None, None),
        (6, "\n\n \t\n", "z"),
        (7, "one\ntwo\nthree\nfour\nfive\nsix\nseven", "z"),
        (8, "zero\none\ntwo\nthree\nfour\nfive\nsix\nseven", "z"),
        (9, "emoji 😀 漢字 ‮ \x00 end", "z"),
    ]
    return spark.createDataFrame([(i, t, s, s, 1, s) for i, t, s in rows], "doc_id long, text string, node string, matches string, n_words int, row string")


@pytest.fixture(scope="session")
def nothing(hostile):
    return hostile.limit(0)
