"""Rows for the tests of this folder."""

import hashlib
import random

from pyspark.sql import types as T

ALERT = T.StructType(
    [
        T.StructField("alert_id", T.LongType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("layout_name", T.StringType()),
        # names that operators use themselves
        T.StructField("_key", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("_size", T.LongType()),
        T.StructField("hash", T.LongType()),
    ]
)
VOCABULARY = [w + e for w in "cash wire split layer transfer deposit shell offshore account ring fan cycle".split() for e in ("", "s", "ed", "ing")]


def narrative(seed: int, words: int) -> str:
    """A made-up alert text."""
    random_words = random.Random(seed)
    return " ".join(random_words.choice(VOCABULARY) for _ in range(words))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows() -> list[tuple]:
    """NULLs in every column, empty and wordless texts, a very long one, ties and repeated rows."""
    same = narrative(1, 80)
    return [
        (1, same, "a"),
        (2, same, "b"),
        (2, same, "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n ", "b"),
        (None, narrative(2, 60), "a"),
        (None, same, None),
        (6, narrative(3, 20_000), "c"),
        (7, "ÉÀ Cash!", "c"),
        (8, narrative(4, 60) + " " + same[:400], "c"),
        (9, narrative(4, 60) + "\n" + same[:400], "a"),
    ]
