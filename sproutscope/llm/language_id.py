"""Language identification by interpolated Kneser-Ney models of character 4-grams.

Characters are lower-cased letters; every run of anything else is one boundary character. Spark
counts the 4-grams of each language over all training texts; the models are made of the counts and
kept as one sorted array of gram hashes per order with a column of log probabilities per language.
A text gets the language of the lowest cross-entropy per character. Documents for calibration,
which the counts leave out, give the sharpness of the confidence and, per length of text, the
cross-entropy beyond which a text is rejected.

No gram is dropped. Counted models of up to ``CELLS`` cells (4-grams times languages) are broadcast. Larger
ones stay tables, with discounts, continuation counts and back-off weights taken from all counts in Spark:
workers then know the most frequent grams, at most ``CELLS / L`` for ``L`` languages, and all other
grams of the texts are joined with the tables. Both ways give the same probabilities.

Defined cases: a null text or one without a letter is ``und`` with score 0 and is rejected; without
any training text every document is ``und``; ties go to the language first in order; repeated rows
count and are judged one by one; texts are read whole; an empty table gives an empty result; columns
of the input are kept, and ``lang`` is never read for a prediction.
"""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope.llm.batches import bounded_batches, once, pieces
from sproutscope.session import stage

ORDER = 4
#: Cells (4-grams times languages) of the models or of the part of them that workers hold.
CELLS = 8_000_000
#: Documents are dealt by crc32 of their id: rest 0 and null ids train, 2 calibrates, 1 is held out.
FOLDS = 3
HELD_OUT, CALIBRATION = 1, 2
SHARPNESS = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
#: Standard deviations above the mean cross-entropy of texts of a length that still are accepted; wide
#: enough for clean texts that mix known languages.
TOLERANCE = 12.0
LEAST_CALIBRATION = 30
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that hashing grams of 64 bits is one to one
_BITS = np.uint64(16)
_KNOWN_GRAMS = 1 << 21


def letter_table() -> np.ndarray:
    """By code point below 65536: the lower-case letter, or 0 for what isn't a letter."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    for point in range(1 << 16):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else point
    return table


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-grams, ends): the grams of all texts, one per character, and where each text's end.

    A gram packs its four characters into 64 bits, the predicted one lowest. A text without a
    letter has no gram; others end with a boundary.
    """
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = table[np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):  # letters beyond share the codes of surrogates
        codes[at] = 0xD800 + points[at] % 2048 if chr(points[at]).isalpha() else 0
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    letter = codes != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # and the first character after letters, as their boundary
    ends = np.cumsum(keep)[ends - 1]
    codes = codes[keep].astype(np.uint64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    grams = codes.copy()
    for back in range(1, ORDER):
        grams[back:] |= codes[:-back] << np.uint64(16 * back)
    for k in range(ORDER - 1):  # nothing before the start of a text
        at = starts + k
        grams[at[at < len(codes)]] &= np.uint64((1 << 16 * (k + 1)) - 1)
    return grams, ends


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows that have a language, summed up inside each task first."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    arrow = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        table = once(("letters",), letter_table)
        found: dict[str, list] = {}
        held = 0

        def merged(name):
            keys = np.concatenate([k for k, _ in found[name]])
            counts = np.concatenate([c for _, c in found[name]])
            own, where = np.unique(keys, return_inverse=True)
            return own, np.bincount(where, weights=counts, minlength=len(own)).astype(np.int64)

        def emit():
            for name in found:
                keys, counts = merged(name)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], schema=arrow)

        for batch in batches:
            for part in pieces(batch, text):
                own, ends = grams([t or "" for t in part.column(text).to_pylist()], table)
                names, which = np.unique(np.array(part.column(lang).to_pylist(), dtype=object).astype(str), return_inverse=True)
                owner = np.repeat(which, np.diff(np.concatenate([[0], ends])))
                for i, name in enumerate(names):
                    counts = pd.Series(own[owner == i]).value_counts(sort=False)
                    if len(counts):
                        found.setdefault(str(name), []).append((counts.index.to_numpy(dtype=np.uint64), counts.to_numpy(dtype=np.int64)))
                        held += len(counts)
                if held > _KNOWN_GRAMS:
                    found = {name: [merged(name)] for name in found}
                    held = sum(len(v[0][0]) for v in found.values())
                    if held > _KNOWN_GRAMS // 2:
                        yield from emit()
                        found, held = {}, 0
        yield from emit()

    bounded_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    return labelled.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language from the counts of its longest grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.tables, self.contexts = {}, {}
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        for o in range(ORDER, 0, -1):
            ones, twos = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            contexts, where = np.unique(keys >> _BITS, return_inverse=True)
            totals = np.bincount(where, weights=counts)
            self.tables[o] = keys, np.maximum(counts - discount, 0) / totals[where]
            self.contexts[o] = contexts, np.bincount(where, weights=np.minimum(counts, discount)) / totals
            if o > 1:  # how many characters a shorter gram follows
                keys, counts = np.unique(keys & np.uint64((1 << 16 * (o - 1)) - 1), return_counts=True)
                counts = counts.astype(np.float64)

    def gamma(self, order: int, contexts: np.ndarray) -> np.ndarray:
        """What a context leaves to the next shorter order."""
        known, values = self.contexts[order]
        return _looked_up(known, values, contexts, 1.0)

    def probability(self, keys: np.ndarray, order: int, alphabet: int) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), 1 / alphabet)
        known, values = self.tables[order]
        shorter = keys & np.uint64((1 << 16 * (order - 1)) - 1)
        return _looked_up(known, values, keys, 0.0) + self.gamma(order, keys >> _BITS) * self.probability(shorter, order - 1, alphabet)


def _looked_up(known: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], default)


def hashed(keys: np.ndarray) -> np.ndarray:
    return keys * _MIX


def build(counted: pd.DataFrame) -> dict:
    """The models as sorted hash arrays, from rows (lang, gram, n).

    ``grams[o]`` and ``contexts[o]``: (sorted hashes, log values with a column per language).
    """
    langs = sorted(counted["lang"].unique())
    models = []
    for name in langs:
        own = counted[counted["lang"] == name]
        models.append(KneserNey(own["gram"].to_numpy(dtype=np.int64).view(np.uint64), own["n"].to_numpy()))
    out = {"langs": langs, "grams": {}, "contexts": {}}
    if not langs:
        return out
    alphabet = len(np.unique(np.concatenate([m.tables[1][0] for m in models]))) + 1
    out["unseen"] = np.array([np.log(m.gamma(1, np.zeros(1, np.uint64))[0] / alphabet) for m in models], dtype=np.float32)
    for o in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([m.tables[o][0] for m in models]))
        out["grams"][o] = _by_hash(keys, [m.probability(keys, o, alphabet) for m in models])
        if o > 1:
            contexts = np.unique(np.concatenate([m.contexts[o][0] for m in models]))
            out["contexts"][o] = _by_hash(contexts, [m.gamma(o, contexts) for m in models])
    return out


def _by_hash(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hashes = hashed(keys)
    order = np.argsort(hashes)
    return hashes[order], np.log(np.maximum(np.stack(columns, axis=1), 1e-30))[order].astype(np.float32)


def _log_probabilities(models: dict, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Of each gram, a column per language; only grams that no language knows go on to shorter ones."""
    if order == 0:
        return np.zeros((len(keys), len(models["langs"])), dtype=np.float32)
    known, values = models["grams"][order]
    hashes = hashed(keys)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    out = values[at]
    missed = np.flatnonzero(known[at] != hashes)
    if len(missed):
        rest = keys[missed]
        if order == 1:
            out[missed] = models["unseen"]
        else:
            contexts, gammas = models["contexts"][order]
            hashes = hashed(rest >> _BITS)
            at = np.minimum(np.searchsorted(contexts, hashes), len(contexts) - 1)
            gamma = np.where((contexts[at] == hashes)[:, None], gammas[at], np.float32(0))
            out[missed] = gamma + _log_probabilities(models, rest & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
    return out


#: Characters scored at a time.
_SLICE = 1 << 18


def entropies(models: dict, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy in nats per character with a column per language, characters) of each text."""
    own, ends = grams(texts, table)
    starts = np.concatenate([[0], ends[:-1]])
    sums = np.zeros((len(texts), len(models["langs"])))
    owner = np.repeat(np.arange(len(texts)), ends - starts)
    for a in range(0, len(own), _SLICE):
        logs, who = _log_probabilities(models, own[a : a + _SLICE]), owner[a : a + _SLICE]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        sums[who[first]] += np.add.reduceat(logs, first, axis=0, dtype=np.float64)
    n = ends - starts
    return -sums / np.maximum(n, 1)[:, None], n


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _low(gram: Column, order: int) -> Column:
    """The last ``order`` characters of a gram."""
    return gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def _by_language(n_langs: int, value: str, default: float) -> Column:
    """Aggregates rows (lang, value) into an array of a value per language."""
    known = F.map_from_entries(F.collect_list(F.struct("lang", value)))  # one row per language
    return F.transform(F.sequence(F.lit(0), F.lit(n_langs - 1)), lambda k: F.coalesce(F.element_at(known, k), F.lit(default)))


def _both(a, b, f) -> Column:
    return F.zip_with(a, b, f)


class Tables:
    """The models of all languages as tables, from rows (lang, gram, n) whose languages are numbers.

    ``grams[o]``: (gram, p) and ``contexts[o]``: (context, gamma), with a column of the languages' values each.
    """

    def __init__(self, counts: DataFrame, n_langs: int):
        counted, self.grams, self.contexts, self.n_langs = {ORDER: counts}, {}, {}, n_langs
        for o in range(ORDER - 1, 0, -1):  # how many characters a shorter gram follows
            shorter = _low(F.col("gram"), o).alias("gram")
            counted[o] = stage(counted[o + 1].groupBy("lang", shorter).agg(F.count("*").alias("n")), "gram-counts")
        alphabet = counted[1].select("gram").distinct().count() + 1
        for o in range(1, ORDER + 1):
            ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
            discount = F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.75)
            # one row per language
            rows = counted[o].join(F.broadcast(counted[o].groupBy("lang").agg(discount.alias("discount"))), "lang")
            rows = rows.withColumn("context", _context(F.col("gram")))
            left = F.sum(F.least("n", "discount")) / F.sum("n")
            contexts = stage(rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), left.alias("gamma")), "gram-contexts")
            own = rows.join(contexts, ["lang", "context"]).select("lang", "gram", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("p"))
            direct = own.groupBy("gram").agg(_by_language(n_langs, "p", 0.0).alias("direct"))
            self.contexts[o] = stage(contexts.groupBy("context").agg(_by_language(n_langs, "gamma", 1.0).alias("gamma")), "gram-contexts")
            direct = direct.withColumns({"context": _context(F.col("gram")), "shorter": _low(F.col("gram"), o - 1)}).join(self.contexts[o], "context")
            if o == 1:
                p = _both("direct", "gamma", lambda d, g: d + g / alphabet)
            else:
                direct = direct.join(self.grams[o - 1].withColumnsRenamed({"gram": "shorter", "p": "lower"}), "shorter")
                p = _both("direct", _both("gamma", "lower", lambda g, q: g * q), lambda d, q: d + q)
            self.grams[o] = stage(direct.select("gram", p.alias("p")), "grams")
        self.unseen = [g / alphabet for g in self.contexts[1].first().gamma]

    def logs(self, wanted: DataFrame) -> DataFrame:
        """(gram, logs): log probabilities by language of all ``wanted`` distinct grams, known or not."""
        ones = F.array_repeat(F.lit(1.0), self.n_langs)
        log = lambda a, b: _both(a, b, lambda x, y: F.log(F.greatest(x * y, F.lit(1e-30))).cast("float")).alias("logs")
        rest, found = wanted.select("gram", F.col("gram").alias("part"), ones.alias("weight")), []
        for o in range(ORDER, 0, -1):
            rows = stage(rest.join(self.grams[o].withColumnRenamed("gram", "part"), "part", "left"), "gram-logs")
            found.append(rows.where("p IS NOT NULL").select("gram", log("weight", "p")))
            rest = rows.where("p IS NULL").drop("p")
            if o > 1:  # grams that no language knows go on to shorter ones
                rest = rest.withColumn("context", _context(F.col("part"))).join(self.contexts[o], "context", "left")
                rest = rest.select("gram", _low(F.col("part"), o - 1).alias("part"), _both("weight", F.coalesce("gamma", ones), lambda w, g: w * g).alias("weight"))
        return reduce(DataFrame.union, found, rest.select("gram", log("weight", F.array(*map(F.lit, self.unseen)))))


SCORED = "lang_best string, entropy double, chars long, margins array<double>"


def scorer(spark, models: dict):
    """A column function: a text's best language, its cross-entropy, length and margins to all languages."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(models)
    kinds = pa.struct([("lang_best", pa.string()), ("entropy", pa.float64()), ("chars", pa.int64()), ("margins", pa.list_(pa.float64()))])

    @F.arrow_udf(SCORED)
    def score(text: pa.Array) -> pa.Array:
        models, table, rows = shared.value, once(("letters",), letter_table), []
        for part in pieces(pa.RecordBatch.from_arrays([text], names=["text"]), "text"):
            texts = [t or "" for t in part.column(0).to_pylist()]
            if not models["langs"]:
                rows.extend({"chars": 0} for _ in texts)
                continue
            found, n = entropies(models, texts, table)
            best = np.argmin(found, axis=1)
            for i, b in enumerate(best):
                rows.append({"lang_best": models["langs"][b], "entropy": found[i, b], "chars": int(n[i]), "margins": (found[i] - found[i, b]).tolist()} if n[i] else {"chars": 0})
        return pa.array(rows, kinds)

    return score


PARTLY = "key string, chars long, sums array<double>, rest array<struct<gram: bigint, n: bigint>>"


def _partly_scored(texts: DataFrame, known: pa.Table, n_langs: int) -> DataFrame:
    """Per text (key, text): characters, summed logs of grams in ``known`` (gram, logs), and counts of the rest."""
    keys = known.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    values = known.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_langs)
    shared = texts.sparkSession.sparkContext.broadcast((keys[order], values[order]))
    pair = pa.struct([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        table, (keys, values) = once(("letters",), letter_table), shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                own, ends = grams(part.column("text").to_pylist(), table)
                chars = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(len(ends)), chars)
                sums = np.zeros((len(ends), n_langs))
                at = np.searchsorted(keys, own)
                has = np.zeros(len(own), dtype=bool)
                inside = at < len(keys)
                has[inside] = keys[at[inside]] == own[inside]
                places, who = at[has], owner[has]
                for a in range(0, len(who), _SLICE):
                    names = who[a : a + _SLICE]
                    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
                    sums[names[first]] += np.add.reduceat(values[places[a : a + _SLICE]], first, axis=0, dtype=np.float64)
                other, who = own[~has], owner[~has]
                ranked = np.lexsort((other, who))
                other, who = other[ranked], who[ranked]
                first = np.flatnonzero(np.concatenate([[True], (other[1:] != other[:-1]) | (who[1:] != who[:-1])])) if len(other) else np.empty(0, np.int64)
                rest = pa.StructArray.from_arrays([pa.array(other[first].view(np.int64)), pa.array(np.diff(first, append=len(other)))], fields=list(pair))
                upto = np.concatenate([[0], np.cumsum(np.bincount(who[first], minlength=len(ends)))]).astype(np.int32)
                arrays = [part.column("key"), pa.array(chars), pa.array(list(sums), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(upto), rest)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "chars", "sums", "rest"])

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(run, PARTLY)


def _scored_by_join(docs: DataFrame, counts: DataFrame, langs: list[str]) -> DataFrame:
    """``docs`` with the scores ``__s``, for models that are too large for a worker."""
    n_langs = len(langs)
    tables = Tables(counts, n_langs)
    totals = stage(counts.groupBy("gram").agg(F.sum("n").alias("n")), "gram-totals")
    total = totals.agg(F.sum("n")).first()[0]
    frequent = totals.where(F.col("n") * F.lit(CELLS // n_langs) >= F.lit(total)).select("gram")
    key = F.md5("text")
    texts = docs.where("text IS NOT NULL").select(key.alias("key"), "text").dropDuplicates(["key"])
    partly = stage(_partly_scored(texts, tables.logs(frequent).toArrow(), n_langs), "partly-scored")
    rest = partly.select("key", F.inline("rest"))
    logs = stage(tables.logs(rest.select("gram").distinct()), "gram-logs")
    each = rest.join(logs, "gram").select("key", "n", F.posexplode("logs").alias("lang", "log"))
    sums = each.groupBy("key", "lang").agg(F.sum(F.col("n") * F.col("log").cast("double")).alias("log"))
    more = sums.groupBy("key").agg(_by_language(n_langs, "log", 0.0).alias("more"))
    nothing = F.array_repeat(F.lit(0.0), n_langs)
    whole = partly.where("chars > 0").join(more, "key", "left").select("key", "chars", _both("sums", F.coalesce("more", nothing), lambda a, b: a + b).alias("sums"))
    ranked = whole.select("key", "chars", F.transform("sums", lambda x: -x / F.col("chars")).alias("found")).withColumn("entropy", F.array_min("found"))
    best = F.element_at(F.array(*map(F.lit, langs)), F.array_position("found", F.col("entropy")).cast("int"))
    margins = F.transform("found", lambda x: x - F.col("entropy"))
    scores = stage(ranked.select(F.col("key").alias("__key"), F.struct(best.alias("lang_best"), "entropy", "chars", margins.alias("margins")).alias("__s")), "scores")
    return docs.withColumn("__key", key).join(scores, "__key", "left").drop("__key")


def with_scores(docs: DataFrame) -> DataFrame:
    """``docs`` with the scores ``__s`` by models of the training fold of ``docs`` (doc_id, lang, text)."""
    trained = docs.where(~fold(F.col("doc_id")).isin(HELD_OUT, CALIBRATION)).select("lang", "text")
    counts = stage(count_grams(trained), "gram-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    codes = F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>")
    numbered = counts.select((F.array_position(codes, F.col("lang")) - 1).cast("int").alias("lang"), "gram", "n")
    # with fewer than four languages the grams that the driver takes are as many as with four
    if counts.count() * max(len(langs), 4) > CELLS:
        return _scored_by_join(docs, numbered, langs)
    counted = numbered.toArrow().to_pandas()
    counted["lang"] = pd.Categorical.from_codes(counted["lang"], langs)
    return docs.withColumn("__s", scorer(docs.sparkSession, build(counted))("text"))


def _confidence(sharpness) -> Column:
    """Of the best language, whose margin is 0."""
    return 1 / F.aggregate("margins", F.lit(0.0), lambda total, m: total + F.exp(-F.lit(sharpness) * m))


def _length_class(chars: Column) -> Column:
    return F.floor(F.log2(chars.cast("double"))).cast("int")


def calibrate(scored: DataFrame) -> tuple[float, list[tuple[int, float]]]:
    """(sharpness, limits of cross-entropy by length class) from all scored calibration documents.

    ``scored``: lang, lang_best, entropy, chars, margins. The sharpness with the least log loss is
    taken. A length class with too few documents has no limit.
    """
    known = scored.where("chars > 0 AND lang IS NOT NULL")
    right = F.col("lang") == F.col("lang_best")

    def loss(s):
        p = F.greatest(F.when(right, _confidence(s)).otherwise(1 - _confidence(s)), F.lit(1e-6))
        return F.avg(-F.log(p)).alias(f"s{s}")

    losses = known.agg(*[loss(s) for s in SHARPNESS]).first()
    best = min(range(len(SHARPNESS)), key=lambda i: (losses[i] is None, losses[i]))
    classes = known.where(right).groupBy(_length_class(F.col("chars")).alias("length")).agg(F.count("*").alias("n"), F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("spread"))
    limits = [(r.length, r.mean + TOLERANCE * r.spread) for r in classes.collect() if r.n >= LEAST_CALIBRATION]
    return SHARPNESS[best], sorted(limits)


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred``, ``score``, ``entropy`` and ``rejected``.

    ``docs`` needs doc_id, text and lang. Texts are counted (training fold), scored for calibration
    (its fold) and scored for the result; only counts and scores are stored in between.
    """
    new = ["held_out", "lang_pred", "score", "entropy", "rejected"]
    scored = with_scores(docs)
    trial = scored.where(fold(F.col("doc_id")) == CALIBRATION).select("lang", "__s.*")
    sharpness, limits = calibrate(stage(trial, "calibration"))
    known = F.col("__s.chars") > 0
    margins = F.aggregate("__s.margins", F.lit(0.0), lambda total, m: total + F.exp(-F.lit(sharpness) * m))
    limit = F.lit(float("inf"))
    if limits:
        by_length = F.create_map(*[F.lit(x) for pair in limits for x in pair])
        limit = F.coalesce(F.element_at(by_length, _length_class(F.col("__s.chars"))), limit)
    return scored.select(
        *[c for c in docs.columns if c not in new],
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        F.when(known, F.col("__s.lang_best")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 / margins).otherwise(0.0).alias("score"),
        F.col("__s.entropy").alias("entropy"),
        F.when(known, F.col("__s.entropy") > limit).otherwise(True).alias("rejected"),
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected; their columns are unchanged."""
    columns = docs.columns
    taken = docs.select(F.struct(*columns).alias("__row"), "doc_id", "lang", "text")
    return identify(taken).where(~F.col("rejected")).select("__row.*")
