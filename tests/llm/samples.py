"""Small tables with everything that operators have to stand: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, node long, ids string, rule string"


def prose(seed: int, words: int, vocabulary: str = "the of and a in is are house water green walking under tree river people") -> str:
    rng = random.Random(seed)
    out = " ".join(f"{rng.choice(vocabulary.split())}{rng.choice(['', '', 's', 'ing'])}" for _ in range(words))
    return ". ".join(out[i:i + 80] for i in range(0, len(out), 80))


def rows() -> list[tuple]:
    texts = [None, "", "   \n\t ", "a", "é", "12345 67890", "😀" * 50, "x" * 30_000, "word " * 3_000, prose(1, 4_000), prose(2, 200), prose(2, 200), prose(3, 120).upper(),
             prose(4, 80) + "\nmail me at jo.doe@example.org or +1 (206) 555-0100\n", "one two three", "One TWO three", "line a b c\nline a b c\n\nother line d e", "a b " * 40]
    texts += [prose(10 + i, 60 + i) for i in range(20)]
    out = [(i, t, [None, "en", "fr", ""][i % 4], f"s{i % 2}", len(t or ""), 0.5, True, 7, "x", "y") for i, t in enumerate(texts)]
    out += [out[10], out[10], (None, prose(2, 200), "en", "s0", 1, 0.1, False, 1, "x", "y"), (None, None, None, None, None, None, None, None, None, None)]
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
