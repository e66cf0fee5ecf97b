"""A quality classifier without labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Each labeller looks at one side of a text and votes good, bad or not at all. The votes of a document
are one pattern, Spark counts the patterns over all documents, and expectation-maximisation fits the
share of good documents and each labeller's chances of each vote in every class to those counts
(at most ``3 ** labellers`` rows, whatever the corpus). Labellers that look at the same side overlap: their bad
votes come together. So there is one class of good documents and one of bad ones per kind of fault, within
which votes are taken as independent; with a single bad class the overlap would pass for quality. The posterior of a pattern is the soft label of
its documents. They train a logistic scorer on hashed word features, which then judges every text,
also where all labellers abstain.

The scorer is fitted on about ``TRAINING_ROWS`` documents, drawn by hashes of text and id; patterns, posteriors and scores cover all documents.

Defined cases: a null text or one without words has score 0 and isn't kept; repeated rows count and are
scored one by one; without documents, or if one class is empty, the posterior alone is the score; an
empty table gives an empty result; columns of the input other than the new ones are kept.
"""

import operator
import re
import zlib
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope.llm.quality_rules import MEASURES, measure
from sproutscope.llm.batches import as_bytes, bounded_batches, pieces
from sproutscope.session import stage

#: name: (condition of a bad vote, condition of a good vote) over the measurements of quality rules
#: and ``MORE``: distinct words, words that end a sentence, letters, bytes, bytes when compressed, words
#: that equal the one before, words of marks only.
LABELLERS = {
    "length": ("n_words < 3", "n_words >= 20"),
    "windows": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "symbols": ("100 * n_symbols > 20 * n_words", "n_symbols = 0"),
    "lines": ("n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    "vocabulary": ("n_words >= 50 AND 100 * n_distinct < 15 * n_words", "n_words >= 20 AND 100 * n_distinct >= 25 * n_words"),
    "letters": ("100 * n_letters < 75 * word_chars", "100 * n_letters >= 85 * word_chars"),
    "sentences": ("n_words >= 50 AND 200 * n_stops < n_words", "n_stops > 0 AND n_stops * 4 < n_words"),
    "packing": ("n_bytes >= 200 AND 100 * n_packed < 35 * n_bytes", "n_bytes >= 200 AND 100 * n_packed >= 42 * n_bytes"),
    "echoes": ("20 * n_twice > n_words", "n_words >= 20 AND 50 * n_twice <= n_words"),
    "lone": ("10 * n_lone > n_words", "n_words >= 20 AND 50 * n_lone <= n_words"),
}
#: Kinds of fault by the labellers that look for them; the others look at what a text is made of.
REPETITION = ("windows", "lines", "vocabulary", "packing", "echoes")
BAD, NONE, GOOD = 0, 1, 2

DIMENSIONS = 1 << 16
TRAINING_ROWS = 20_000
EM_STEPS = 200
ITERATIONS = 40
KEEP = 0.5

#: Words of ASCII marks only.
_LONE = re.compile(rb"(?<![^\x20\x09-\x0d])[!-/:-@\[-`{-~]+(?![^\x20\x09-\x0d])")

MORE = ["n_distinct", "n_stops", "n_letters", "n_bytes", "n_packed", "n_twice", "n_lone"]
_OTHER = bytes(b for b in range(128) if not chr(b).isalpha()) + bytes(range(0x80, 0xC0))  # and no byte that goes on a character


def more(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MORE``."""
    words = text.split()
    stops = sum(w[-1:] in b".!?" for w in words)
    echoes = sum(map(operator.eq, words, islice(words, 1, None)))
    return len(set(words)), stops, len(text.translate(None, _OTHER)), len(text), len(zlib.compress(text, 1)), echoes, len(_LONE.findall(text))


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in [*MEASURES, *MORE]]))
def _measured(text: pa.Array) -> pa.Array:
    rows = [(*measure(t), *more(t or b"")) for t in as_bytes(text)]
    table = np.array(rows, dtype=np.int64).reshape(-1, len(MEASURES) + len(MORE))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], names=[*MEASURES, *MORE])


def pattern_of_votes() -> Column:
    """The votes of all labellers as one number, three digits each to the base 3."""
    total = F.lit(0)
    for k, (bad, good) in enumerate(LABELLERS.values()):
        total = total + F.when(F.expr(bad), BAD).when(F.expr(good), GOOD).otherwise(NONE) * 3**k
    return F.when(F.col("n_words") > 0, total)


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """The votes of each pattern, a column per labeller."""
    return (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, chances [labeller, class, vote], posterior of good per pattern) by EM.

    It starts with every document bad that has two bad votes of one side, in the kind of fault that has most of
    them, and every other one good: labellers that agree are the evidence, one alone may err. The chances of bad and good are of the votes cast and never 0, those of
    class 0 are of all kinds of bad documents together.
    """
    votes = votes_of(patterns)
    repeats = np.array([name in REPETITION for name in LABELLERS])
    found = np.stack([(votes[:, side] == BAD).sum(axis=1) for side in (repeats, ~repeats)])
    start = np.where(found.max(axis=0) > 1, found.argmax(axis=0), len(found))
    posterior = np.where(start == np.arange(len(found) + 1)[:, None], 0.96, 0.02)  # the good ones last
    chances = np.empty((len(LABELLERS), len(posterior), 3))

    def cast(weights: np.ndarray, j: int) -> np.ndarray:
        seen = np.bincount(votes[:, j], weights=weights, minlength=3) + 1.0
        seen[NONE] = 0.0
        return seen / seen.sum()

    for _ in range(steps):
        weights = counts * posterior
        shares = (weights.sum(axis=1) + 1) / (counts.sum() + len(posterior))
        for j in range(len(LABELLERS)):
            for c in range(len(posterior)):
                chances[j, c] = cast(weights[c], j)
        chances[:, :, NONE] = 1.0  # no vote says nothing, as it mostly means a short text
        logs = np.log(chances)[np.arange(len(LABELLERS)), :, votes].sum(axis=1).T + np.log(shares)[:, None]
        posterior = np.exp(logs - logs.max(axis=0))
        posterior /= posterior.sum(axis=0)
    good = posterior[-1]
    both = np.array([[cast(counts * (1 - good), j), cast(counts * good, j)] for j in range(len(LABELLERS))])
    both[:, :, NONE] = 1.0
    return float(shares[-1]), both, good


def accuracies(chances: np.ndarray, prior: float) -> dict[str, float]:
    """Of each labeller: how often a vote is right."""
    right = (1 - prior) * chances[:, 0, BAD] + prior * chances[:, 1, GOOD]
    cast = right + (1 - prior) * chances[:, 0, GOOD] + prior * chances[:, 1, BAD]
    return dict(zip(LABELLERS, (right / cast).tolist(), strict=True))


def _places(words: pa.Array) -> np.ndarray:
    return (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % DIMENSIONS).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed feature, value), ascending, the values of a text of norm 1.

    Words, their shapes, and words that repeat the one before; a text without words has none.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    owner, words = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy())), cut.values
    real = pc.greater(pc.binary_length(words), 0)
    owner, coded = owner[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()
    codes = coded.indices.to_numpy()
    letters = pc.replace_substring_regex(coded.dictionary, r"[a-z\x{80}-\x{10FFFF}]+", "a")
    shapes = pc.binary_join_element_wise("shape ", pc.replace_substring_regex(letters, "[0-9]+", "0"), "").dictionary_encode()
    again = owner[1:][(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])]
    by_word, by_shape = _places(coded.dictionary), _places(shapes.dictionary)[shapes.indices.to_numpy()]
    where = np.concatenate([owner, owner, again])
    keys = np.concatenate([by_word[codes], by_shape[codes], np.repeat(_places(pa.array(["repeat of a word"])), len(again))])
    both, counts = np.unique(where * DIMENSIONS + keys, return_counts=True)
    of = both // DIMENSIONS
    return of, both % DIMENSIONS, np.sqrt(counts / np.bincount(where, minlength=len(texts))[of])


@F.arrow_udf(T.StructType([T.StructField("keys", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]))
def _features(text: pa.Array) -> pa.Array:
    out = []
    for part in pieces(pa.RecordBatch.from_arrays([text], names=["text"]), "text"):
        of, keys, values = features(part.column(0))
        upto = pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)), pa.int32())
        columns = [pa.ListArray.from_arrays(upto, pa.array(keys, pa.int32())), pa.ListArray.from_arrays(upto, pa.array(values, pa.float64()))]
        out.append(pa.StructArray.from_arrays(columns, names=["keys", "values"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("keys", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))


def _train(rows: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights and intercept from rows (text, p); each text counts as good by p and as bad by 1 - p."""
    vector = F.udf(lambda f: SparseVector(DIMENSIONS, f["keys"], f["values"]), VectorUDT())  # of the drawn rows only
    made = rows.select(_features("text").alias("f"), "p").select(vector("f").alias("features"), "p")
    both = made.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))).alias("x"))
    both = stage(both.select("features", "x.*").where("w > 0"), "scorer-training")
    if both.select("label").distinct().count() < 2:
        return None
    model = LogisticRegression(maxIter=ITERATIONS, regParam=1e-6, weightCol="w", standardization=False).fit(both)
    return model.coefficients.toArray(), float(model.intercept)


def _scorer(spark, model):
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS numbers

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        weights, intercept = shared.value
        out = []
        for part in pieces(pa.RecordBatch.from_arrays([text], names=["text"]), "text"):
            of, keys, values = features(part.column(0))
            sums = np.bincount(of, weights=weights[keys] * values, minlength=part.num_rows)
            seen = np.bincount(of, minlength=part.num_rows) > 0
            out.append(np.where(seen, 1 / (1 + np.exp(-np.clip(sums + intercept, -50, 50))), 0.0))
        return pa.array(np.concatenate([np.empty(0), *out]), pa.float64())

    return score


def classify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and more) without the text, with ``pattern``, ``p_weak``, ``score`` and ``kept``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    new = ["pattern", "p_weak", "score", "kept", "text"]
    others = [c for c in docs.columns if c not in new]
    row = F.struct(F.lit(0).alias("__none"), *others).alias("row")  # apart from names of measurements
    voted = docs.select(row, "text", _measured("text").alias("m")).select("row", "text", "m.*").select("row", "text", pattern_of_votes().alias("pattern"))
    voted = stage(voted, "votes")  # texts are measured once
    counted = voted.groupBy("pattern").count().toPandas().dropna().astype("int64").sort_values("pattern")
    if counted.empty:
        scored = voted.withColumns({"p_weak": F.lit(0.0), "score": F.lit(0.0)})
        return _result(scored, others)
    _, _, posterior = fit_labellers(counted["pattern"].to_numpy(), counted["count"].to_numpy())
    by_pattern = spark.createDataFrame([(int(p), float(q)) for p, q in zip(counted["pattern"], posterior, strict=True)], "pattern int, p_weak double")
    voted = voted.join(F.broadcast(by_pattern), "pattern", "left")
    share = min(1.0, TRAINING_ROWS / float(counted["count"].sum()))
    drawn = F.pmod(F.xxhash64("text", *[F.col("row")["doc_id"]] * ("doc_id" in others)), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))
    chosen = voted.where(drawn).where("p_weak IS NOT NULL").select("text", F.col("p_weak").alias("p"))
    model = _train(chosen)
    score = F.coalesce("p_weak", F.lit(0.0)) if model is None else _scorer(spark, model)(F.col("text"))
    scored = voted.withColumn("score", score).withColumn("p_weak", F.coalesce("p_weak", F.lit(0.0)))
    return _result(scored, others)


def _result(scored: DataFrame, others: list[str]) -> DataFrame:
    return scored.select(*[F.col("row")[c].alias(c) for c in others], "pattern", "p_weak", "score", ((F.col("score") >= KEEP) & F.col("pattern").isNotNull()).alias("kept"))
