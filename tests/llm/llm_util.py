"""Small tables with every awkward row, and plain-Python definitions."""

import re

from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Null and empty texts, nulls in every column, repeated rows and ids, a long text, odd white space."""
    rows = [(1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
            (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
            (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id at all here", "en", "b", 17),
            (None, "no id at all here", "en", "b", 17), (4, " \t\n ", "fr", "a", 4), (5, "Café naïve 中文 \U0001f600 x", "fr", "a", 15),
            (6, "word " * 30_000, "en", "a", 150_000), (7, "x" * 20_000, "de", "c", 20_000), (8, "12345 !!! 678", "de", "c", 13),
            (8, "another text with the same id", "de", "c", 29)]
    return spark.createDataFrame(rows, DOC)


def empty(df):
    return df.where(F.lit(False))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ws_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
