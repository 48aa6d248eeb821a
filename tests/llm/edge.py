"""Small tables of hard cases, and words of brute-force versions."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"


def hard(spark):
    """Nulls in every column, empty and very long texts, ties, copies, repeated rows, and columns whose names clash."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 5, "mine", 0.1),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", None, "a", 5, None, None),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", None, "a", 5, None, None),
        (3, None, "en", None, None, "x", 0.0),
        (4, "", "en", "b", 0, "x", 0.0),
        (5, "   \n\t ", "en", "b", 0, "x", 0.0),
        (6, long, "en", "c", None, "x", 0.0),
        (None, "a text without a key, and a passage that stands elsewhere as well, of some length", "en", "a", None, None, None),
        (8, "café Übergröße 漢字 a passage that stands elsewhere as well, of some length 😀", "xx", "b", 1, None, None),
        (9, "one", "en", "a", 1, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")
