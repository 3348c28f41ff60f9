"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, copies int, fp string"


def words(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdeéñß") for _ in range(pick.randint(1, 8))) for _ in range(n))


def documents() -> list[tuple]:
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, words(3, 60), "en", "b", 1),
        (4, words(3, 60), "en", "b", 1),
        (5, words(3, 60).replace(" a", " A"), "en", None, 1),
        (6, "one two three", None, "é", 1),
        (7, words(7, 20_000), "en", "b", 1),
        (8, words(8, 300) + "\n\n  \t x  ", "de", "", 1),
        (9, "tab\tand\x0bvertical\x1codd space　wide 'll it's", "de", "z", 1),
        (10, words(3, 30) + " " + words(3, 60), "de", None, 1),
        (10, words(3, 30) + " " + words(3, 60), "de", None, 1),
        (11, words(12, 13), "fr", "b", 1),
        (12, words(12, 13), "fr", "b", 1),
        (None, "no id here at all", "fr", "b", 1),
        (None, None, None, None, None),
    ]
    rows += [(100 + i, words(50 + i % 7, 20 + i % 5), "en", "hot", 1) for i in range(60)]
    return [(*row, "a name used inside", 9, "x") for row in rows]


def frame(spark):
    return spark.createDataFrame(documents(), DOC_SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
