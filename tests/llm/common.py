"""Small tables with the odd rows that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

WORDS = "river stone lamp under seven quiet paper window garden morning yellow carry bread silver north letter".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "er", "ly"]) + rng.choice(["", "a", "o", "x", "q"]) for _ in range(n))


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows: list[tuple]):
    """Rows of (doc_id, text[, lang[, source]]), with extra columns whose names clash with inner ones."""
    full = [(r + (None,) * 4)[:4] for r in rows]
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], DOCS)
    for name in ("spans", "_text", "_base", "size", "class_id", "band", "score", "block", "word", "held_out"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


#: Null, empty, blank, one word, very long, repeated rows, ties.
ODD = [
    (None, prose(1, 30)), (1, None), (2, ""), (3, " \n\t "), (4, "lamp"), (5, prose(2, 60)), (6, prose(2, 60)), (6, prose(2, 60)),
    (7, "é" * 3000 + " " + prose(3, 400_000)), (8, "x" * 3_000_000), (9, "…\x00\U0001f600 ok"), (10, "lamp"),
]

