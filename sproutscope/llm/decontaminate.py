"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A token is a run of letters and digits, lower-cased; in scripts that don't part words by spaces it is one
character. A mask reads some positions of a few tokens in a
row and ignores the others; its hash is equal in a document and a test item even if ignored tokens
were substituted. A hit fixes how the item lies over the document, and the overlap counts if, in some
window of ``WINDOW`` tokens of the item (all of a shorter one), at most ``(window - 7) / 2`` differ:
3 of 13 tokens, none of 8.

The three masks hit every window with so few substitutions, wherever they are, so the seeds lose
nothing that the verification would accept.

The hashes of the items are broadcast while a count shows that there are at most ``BROADCAST_SEEDS``
of them. Beyond it, documents and items are joined by hash in a shuffle of (text, position, hash).
Texts are cut into parts of a bounded number of tokens first, so a long text is many small rows.

Items too short for a window (fewer than ``LEAST_TOKENS``) are searched in a second pass, made only if there are
any: without substitutions, by the hash of all their tokens in a row. As one to three common words are found
in many clean documents, items of fewer than ``LEAST_RUN`` tokens have to be the whole text.

Defined cases: null and empty texts and items have no tokens and no overlap; equal items are
all reported; repeated documents are all reported; empty tables give an empty result.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sproutscope.session import stage

MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 3, 4, 5))
WINDOW = 13
LEAST_TOKENS = 8
LEAST_RUN = 4
#: Own tokens of a part of a text, and those beyond that its masks and windows reach.
PART, MARGIN = 4096, 2 * WINDOW
BROADCAST_SEEDS = 1_000_000  # of some 300 bytes

TOKEN = r"[\p{L}\p{N}]+"
#: Thai, Lao, Burmese, Khmer, kana and Han characters, by their blocks.
UNSPACED = r"([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}])"


def token_hashes(text: Column) -> Column:
    lower = F.lower(text)
    spaced = F.when(F.octet_length(lower) > F.length(lower), F.regexp_replace(lower, UNSPACED, " $1 ")).otherwise(lower)
    return F.transform(F.regexp_extract_all(spaced, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def _seed(tokens: Column, at: Column, number: int) -> Column:
    """The hash of a mask laid at a position; null where it reaches beyond the end."""
    mask = MASKS[number]
    hashed = F.xxhash64(F.lit(number), *[F.get(tokens, at + offset) for offset in mask])
    return F.when(at + mask[-1] < F.size(tokens), hashed)


def parts(rows: DataFrame) -> DataFrame:
    """Rows with an array ``tokens`` as parts of ``PART`` tokens with ``MARGIN`` more on either side.

    ``part``: the tokens, ``first``: the place of its first own token in it, ``base``: that token's
    place in the text. So what a long text becomes is spread over rows of bounded size.
    """
    bases = F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(PART))
    low = lambda b: F.greatest(b - MARGIN, F.lit(0))
    cut = lambda b: F.struct(F.slice("tokens", low(b) + 1, PART + 2 * MARGIN).alias("part"), (b - low(b)).alias("first"), b.alias("base"))
    others = [c for c in rows.columns if c != "tokens"]
    return rows.where(F.size("tokens") > 0).select(*others, F.inline(F.transform(bases, cut)))


def seeds(rows: DataFrame) -> DataFrame:
    """Parts as one row per own position and mask, with ``place`` (in the part) and ``seed``."""
    own = F.least(F.lit(PART), F.size("part") - F.col("first"))
    placed = rows.select("*", F.explode(F.sequence(F.col("first"), F.col("first") + own - 1)).alias("place"))
    all_masks = F.array(*[_seed(F.col("part"), F.col("place"), k) for k in range(len(MASKS))])
    return placed.select("*", F.explode(all_masks).alias("seed")).where("seed IS NOT NULL")


def _around(tokens: Column, place: Column) -> Column:
    """The tokens from ``WINDOW - 1`` before a place to as many after it; nulls beyond the ends."""
    return F.array(*[F.get(tokens, place + k) for k in range(1 - WINDOW, WINDOW)])


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens) of each test item that has a token."""
    return benchmark.select("item_id", token_hashes(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)


def item_seeds(tests: DataFrame) -> DataFrame:
    """(seed, item_id, item_at, width, item_near) of all positions and masks of test items."""
    width = F.least(F.size("tokens"), F.lit(WINDOW)).alias("width")
    laid = seeds(parts(tests.select("item_id", width, "tokens")))
    return laid.select("seed", "item_id", (F.col("place") - F.col("first") + F.col("base")).alias("item_at"), "width", _around(F.col("part"), F.col("place")).alias("item_near"))


def _matches() -> Column:
    """Most equal tokens in a window of the item that holds the seed's first token."""
    equal = F.zip_with("item_near", "near", lambda a, b: F.when(a == b, 1).otherwise(0))
    counts = F.transform(
        F.sequence(F.lit(1), F.lit(2 * WINDOW) - F.col("width")),
        lambda s: F.when(
            F.get("item_near", s - 1).isNotNull() & F.get("item_near", s + F.col("width") - 2).isNotNull(),
            F.aggregate(F.slice(equal, s, F.col("width")), F.lit(0), lambda total, e: total + e),
        ).otherwise(0),
    )
    return F.array_max(counts)


def _verified(hits: DataFrame) -> DataFrame:
    """Of hits (near, item_near, width and more), those that verify, with ``matched``."""
    # a filter on a random column isn't pushed into the join, which would take the join out of
    # generated code and hold all positions of a part in memory
    made = hits.withColumns({"matched": _matches(), "_apart": F.rand(0)})
    return made.where("matched >= width - (width - 7) DIV 2 AND _apart >= 0").drop("_apart")


def short_overlaps(texts: DataFrame, short: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(text_key, item_id, matched, width) of texts (text_key, tokens) that hold an item of few tokens as it is."""
    index = stage(short.select("item_id", "tokens", F.size("tokens").alias("width"), F.xxhash64("tokens").alias("seed")), "short-items")
    widths = [r.width for r in index.select("width").distinct().collect()]  # fewer than LEAST_TOKENS
    whole = [w for w in widths if w < LEAST_RUN]
    found = [texts.where(F.size("tokens").isin(whole)).select("text_key", F.col("tokens").alias("run"))] if whole else []
    runs = [w for w in widths if w >= LEAST_RUN]
    if runs:
        laid = parts(texts).select("text_key", "part", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + PART, F.size("part")) - 1)).alias("place"))
        at_place = F.array(*[F.when(F.col("place") + w <= F.size("part"), F.slice("part", F.col("place") + 1, w)) for w in runs])
        found.append(laid.select("text_key", F.explode(at_place).alias("run")).where("run IS NOT NULL"))
    if not found:
        return texts.select("text_key", F.lit(0).alias("item_id"), F.lit(0).alias("matched"), F.lit(0).alias("width")).where("false")
    seeded = reduce(DataFrame.union, found).withColumn("seed", F.xxhash64("run"))
    other = F.broadcast(index) if index.count() <= broadcast_seeds else index
    hits = seeded.join(other, "seed").where(F.col("run") == F.col("tokens"))
    return hits.select("text_key", "item_id", F.col("width").alias("matched"), "width").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(text_key, item_id, matched, width): the best overlap of each text with each item.

    ``text_key`` is the text's md5, so repeated documents are found together.
    """
    tests = stage(items(benchmark), "items")
    texts = docs.select(F.md5("text").alias("text_key"), token_hashes(F.col("text")).alias("tokens"))
    long_ones, short_ones = tests.where(F.size("tokens") >= LEAST_TOKENS), tests.where(F.size("tokens") < LEAST_TOKENS)
    found = _spaced_overlaps(texts, stage(item_seeds(long_ones), "seeds"), broadcast_seeds)
    return found if short_ones.isEmpty() else found.unionByName(short_overlaps(texts, short_ones, broadcast_seeds))


def _spaced_overlaps(texts: DataFrame, index: DataFrame, broadcast_seeds: int) -> DataFrame:
    rows = parts(texts)
    laid = seeds(rows)
    near = _around(F.col("part"), F.col("place")).alias("near")
    if index.count() <= broadcast_seeds:
        hits = laid.join(F.broadcast(index), "seed").select("text_key", "item_id", "width", "item_near", near)
    else:
        found = laid.select("text_key", "base", "place", "seed").join(index, "seed")
        narrow = found.select("text_key", "base", "place", "item_id", "width", "item_near").distinct()
        hits = narrow.join(rows.dropDuplicates(["text_key", "base"]), ["text_key", "base"]).select("text_key", "item_id", "width", "item_near", near)
    return _verified(hits).groupBy("text_key", "item_id").agg(F.max("matched").alias("matched"), F.first("width").alias("width"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, width): every document that overlaps a test item, with the item."""
    found = stage(overlaps(docs, benchmark), "overlaps")
    keyed = docs.select("doc_id", F.md5("text").alias("text_key"))
    return keyed.join(found, "text_key").select("doc_id", "item_id", "matched", "width")


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap; their columns are unchanged."""
    found = stage(overlaps(docs, benchmark).select("text_key").distinct(), "leaks")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.md5("text").alias("text_key"))
    return keyed.join(found, "text_key", "left_anti").select("row.*")
