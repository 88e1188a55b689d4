"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

WORDS = [f"w{i}" for i in range(40)]
STOP = ["the", "of", "and", "to", "in"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(STOP) if rng.random() < 0.3 else f"{rng.choice(WORDS)}{rng.choice('abcdefgh')}" for _ in range(n))


def documents(spark, rows, extra: bool = True):
    """(doc_id, text) rows as a table with further columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    if extra:
        schema += ", row string, key string, digest string, kept string, blob string, w int, words string, id long, `set` int"
        data = [(*d, "r", "k", "d", "kept", "b", 1, "x", 7, 2) for d in data]
    return spark.createDataFrame(data, schema)


def words_of(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def edge_rows() -> list:
    """Null, empty, blank, tiny, very long, repeated and null-id rows."""
    rng = random.Random(3)
    long = prose(rng, 60)
    return [(1, None), (2, ""), (3, " \n\t \r\n"), (4, "one two"), (None, long), (None, None), (5, long), (5, long), (6, long),
            (7, prose(rng, 20_000)), (8, long + " tail"), (9, "é ß 日本 😀 ▁x"), (10, "Ab.\nAb.\nAb.")]
