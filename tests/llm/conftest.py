import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Reproducible pseudo-words: ``prose(seed, n)`` gives n words."""
    def make(seed, n, size=400):
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 9))) for _ in range(size)]
        return [rng.choice(vocabulary) for _ in range(n)]
    return make


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with ids in order and extra columns whose names clash with those of the operators."""
    def make(texts, sources=None, ids=None):
        rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else "a", len(t or ""), f"x{i}", i, True)
                for i, t in enumerate(texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, size long, kept boolean")
    return make
