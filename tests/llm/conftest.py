from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    letters = "bcdfghklmnprst"
    return " ".join("".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def make_docs(spark):
    def make(texts, **more):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(rows, DOCS)

    return make
