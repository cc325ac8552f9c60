import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]])."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def prose():
    """Invented words, sentences of them and edits of a text by words."""

    class Prose:
        def __init__(self, seed=5):
            self.rng = random.Random(seed)
            parts = ["ka", "lo", "mer", "ti", "sun", "dra", "vel", "po", "ni", "qua"]
            self.vocabulary = ["".join(self.rng.choice(parts) for _ in range(self.rng.randint(1, 4))) for _ in range(800)]

        def text(self, n):
            return " ".join(self.rng.choice(self.vocabulary) for _ in range(n))

        def edited(self, text, n):
            words = text.split()
            for _ in range(n):
                words[self.rng.randrange(len(words))] = self.rng.choice(self.vocabulary)
            return " ".join(words)

    return Prose()
