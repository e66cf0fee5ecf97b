import hashlib

import pytest


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) pairs, with further columns."""

    def make(pairs, lang="en"):
        rows = [(i, t, lang if isinstance(lang, str) else lang.get(i), "src0", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def prose():
    """Reproducible text of ``n`` made-up words."""

    def make(seed, n, alphabet="abcdefghijklmnoprstu"):
        words = []
        for k in range(n):
            h = hashlib.md5(f"{seed}-{k}".encode()).digest()
            words.append("".join(alphabet[b % len(alphabet)] for b in h[: 2 + h[15] % 6]))
        return " ".join(words)

    return make
