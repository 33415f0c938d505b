"""Small corpora and what brute force makes of them."""

from __future__ import annotations

import random
import re

from worldfold.llm.words import WORD_RE

SCHEMA = "doc_id long, text string"
_WORD = re.compile(WORD_RE)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def invented(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" if rng.random() < 0.6 else rng.choice("the of and to in that is it".split()) for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Documents with exact and near copies, shared passages, nulls, empty ones, a long one and a repeated row."""
    rng = random.Random(seed)
    docs = [invented(rng, rng.choice([1, 5, 30, 120, 300])) for _ in range(n)]
    shared = invented(rng, 70)
    for k in range(0, n, 6):
        docs[k][len(docs[k]) // 2 : len(docs[k]) // 2] = shared
    for k in range(1, n, 7):
        docs.append(list(docs[k]))
        near = list(docs[k])
        for j in range(0, len(near), 25):
            near[j] = f"x{rng.randrange(999)}"
        docs.append(near)
    docs.append(invented(rng, 6000) + shared)
    rows: list[tuple[int | None, str | None]] = [(i, " ".join(d) + ".") for i, d in enumerate(docs)]
    return [*rows, rows[3], (9001, ""), (9002, None), (9003, ""), (None, rows[5][1]), (9004, " ,.! ")]


def with_extras(df):
    """``df`` with columns named like what operators use inside."""
    from pyspark.sql import functions as F

    for name in ("h", "pos", "token", "block", "digest", "key", "id", "a", "b", "rep", "_row", "size", "places", "kind", "lang2"):
        df = df.withColumn(name, F.lit("clash"))
    return df
