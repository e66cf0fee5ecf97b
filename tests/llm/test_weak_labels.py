import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from sproutscope.llm import weak_labels as w

SF = "/root/testdata/sf0.01"


def test_em_recovers_known_accuracies():
    rng = np.random.default_rng(5)
    n, k = 20_000, len(w.LABELLERS)
    good = rng.random(n) < 0.7
    accuracy = np.linspace(0.75, 0.98, k)
    right = rng.random((n, k)) < accuracy
    votes = np.where(rng.random((n, k)) < 0.2, w.NONE, np.where(right == good[:, None], w.GOOD, w.BAD))
    patterns, where, counts = np.unique((votes * 3 ** np.arange(k)).sum(axis=1), return_inverse=True, return_counts=True)
    prior, chances, posterior = w.fit_labellers(patterns, counts)
    assert abs(prior - 0.7) < 0.03
    assert np.abs(np.array(list(w.accuracies(chances, prior).values())) - accuracy).max() < 0.03
    assert ((posterior[where] >= 0.5) == good).mean() > 0.97


def test_em_tells_kinds_of_faults_from_quality():
    """Labellers of one side vote bad together, on documents of their kind of fault alone."""
    rng = np.random.default_rng(6)
    n, repeats = 20_000, np.array([name in w.REPETITION for name in w.LABELLERS])
    kind = rng.choice(3, n, p=[0.08, 0.06, 0.86])  # repetition, other faults, good
    chance = np.where(kind[:, None] == 2, 0.01, np.where((kind[:, None] == 0) == repeats, 0.8, 0.01))
    votes = np.where(rng.random(chance.shape) < 0.1, w.NONE, np.where(rng.random(chance.shape) < chance, w.BAD, w.GOOD))
    patterns, where, counts = np.unique((votes * 3 ** np.arange(len(repeats))).sum(axis=1), return_inverse=True, return_counts=True)
    prior, chances, posterior = w.fit_labellers(patterns, counts)
    assert abs(prior - 0.86) < 0.02
    assert ((posterior[where] >= 0.5) == (kind == 2)).mean() > 0.98
    assert (chances[:, 1, w.BAD] < 0.03).all()


def test_features_by_hand():
    texts = ["The cat the\tthe 12a", None, " ", "ÉA 7 7\n", "a"]
    of, keys, values = w.features(pa.array(texts, pa.string()))
    hashed = lambda word: int(w._places(pa.array([word]))[0])
    shape = lambda word: "shape " + re.sub("[0-9]+", "0", re.sub("[a-z\x80-\U0010ffff]+", "a", word))
    want = []
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own = Counter(hashed(f) for w_ in words for f in (w_, shape(w_)))
        own[hashed("repeat of a word")] += sum(a == b for a, b in zip(words, words[1:], strict=False))
        want += [(k, f, math.sqrt(c / own.total())) for f, c in sorted(own.items()) if c]
    assert [(a, b, round(c, 9)) for a, b, c in zip(of.tolist(), keys.tolist(), values.tolist(), strict=True)] == [(a, b, round(c, 9)) for a, b, c in want]


def test_patterns_by_hand(spark, docs, prose):
    rows = w.classify(docs([(1, prose(1, 60) + "."), (2, "### " * 60), (3, None), (4, "one two")])).collect()
    by = {r.doc_id: r for r in rows}
    votes = dict(zip(w.LABELLERS, w.votes_of(np.array([by[2].pattern]))[0], strict=True))
    assert votes["symbols"] == votes["windows"] == votes["letters"] == w.BAD
    assert by[3].pattern is None and by[3].score == 0 and not by[3].kept


def test_empty_table_and_clashing_columns(docs, prose):
    assert w.classify(docs([])).count() == 0
    rows = w.classify(docs([(1, prose(1, 60))] * 2).selectExpr("*", "'x' AS score", "1 AS n_words")).collect()
    assert len(rows) == 2 and all(0 <= r.score <= 1 and r.n_words == 1 for r in rows)
    assert w.classify(docs([(1, None)])).first().score == 0


@pytest.fixture(scope="module")
def judged(spark):
    found = entry.queries()["op4_weak_labels"](spark, SF).toPandas()
    return found, found.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")


def test_accuracy_against_labels_that_it_never_saw(judged):
    found, labelled = judged
    assert len(found) == 1000
    assert labelled[labelled.quality == 1].kept.mean() > 0.98
    assert labelled[labelled.quality == 0].kept.mean() < 0.1


def test_runs_after_the_rules_in_one_session(spark):
    """The measuring function travels to workers whether or not its own query ran before."""
    from sproutscope.llm.queries import queries

    folder, own = "/root/testdata/sf0.001", queries()
    own["op1_rule_ledger"](spark, folder).collect()
    first = own["op4_weak_labels"](spark, folder).count()
    assert first == own["op1_rule_ledger"](spark, folder).count() == own["op4_weak_labels"](spark, folder).count()
