"""Small corpora with everything that goes wrong: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, key string"
LANGS = {"en": "the of and house river stone green window walking under bright morning table".split(), "fr": "le la des maison rivière pierre verte fenêtre sous matin clair table où été".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(["", "", "s", "ed", "er", str(rng.randrange(9))]) for _ in range(n))


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "fr" if i % 3 == 0 else "en"
        text = "\n".join(sentence(rng, lang, rng.randrange(5, 40)) + "." for _ in range(rng.randrange(1, 6)))
        rows.append([i, text, lang, ["a", "b", None][i % 3]])
    for i, j in ((50, 3), (51, 3), (52, 4)):
        rows[i][1] = rows[j][1]
    words = rows[5][1].split()
    rows[53][1] = " ".join(words[:-1] + ["changed"])
    rows[54][1], rows[55][1], rows[56][1], rows[57][1] = None, "", " \n\t ", "12 34 !!"
    rows[58][1] = sentence(rng, "en", 30_000)
    out = [(r[0], r[1], r[2], r[3], None, "x", "y", "z") for r in rows]
    return [*out, out[2], (None, rows[6][1], None, None, 1, None, None, None)]


def documents(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
