"""Mixing sources to target weights by systematic sampling.

Sources share the words of the whole corpus by weight; a source is repeated at most ``most`` times, and
what it can't take is shared out among the others by weight until none is above its bound. All documents
of a source have the same expected copies, its target over its size. Their sums are taken in the order
of size, one random offset per source is added, and a document is emitted once per whole number that its
sum crosses. In that order the words taken differ from the target by the longest document at most.

Everything is counted in whole numbers, so reruns agree and no document is taken more often than
``most`` times. Positions come from ranges of the sorted rows and the sizes of the ranges, so a source
with most of the rows is spread over many tasks. The loop over bounds reads one row per source.

Defined cases: a null text has size 0; null is a source of its own, after all others; a source without a
word has target 0 and no copies; rows with equal ids are documents of their own; documents of equal size
go by ``doc_id`` (nulls first) and then by a hash of the row; without documents the result is empty;
columns of the input are kept, those with the name of a new one are replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sproutscope.session import stage
from sproutscope.sizing import attach

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 42
#: An offset is a multiple of one over this.
OFFSETS = 1 << 16

_LOCAL_BITS = 33  # of ``monotonically_increasing_id``; those above number the partition


def with_size(docs: DataFrame) -> DataFrame:
    """Adds ``size``, the words of the whole text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def numbered(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Adds ``position``, the place of a row among all rows in that order, from 0."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # bounded: one row per partition of the sort
    joined = placed.join(F.broadcast(bases), "_part")
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return joined.withColumn("position", F.col("_base") + local).drop("_part", "_base", "_at")


def _decimal(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("decimal(19,0)")


def _bounded_share(sources: DataFrame, most: int) -> tuple[int, int]:
    """(words, weights) left for the sources that stay below their bound: each gets ``weight * words / weights``.

    Each round leaves out the sources that are above, which raises the share of the rest.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("source_size", "weight")]
    all_words, all_weights = sources.agg(*sums).first()
    words, weights = all_words, all_weights
    while True:
        above = _decimal(F.col("weight")) * _decimal(words) > _decimal(F.col("source_size")) * _decimal(most * weights)
        size, weight = sources.where(above).agg(*sums).first()
        left = all_words - most * size, all_weights - weight
        if left == (words, weights):
            return left
        words, weights = left


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """One row per source: _source, source_size, weight, target, and the expected copies of a document as _above / _below."""
    totals = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    order = [F.col("_source").asc_nulls_last()]
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = numbered(totals, order, "sources")
    sources = stage(placed.select("_source", "source_size", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int")).cast("long").alias("weight")), "weights")
    words, shares = _bounded_share(sources, most)
    share = _decimal(F.col("weight")) * _decimal(words)
    bound = _decimal(F.col("source_size")) * _decimal(most * shares)
    empty, full = F.col("source_size") == 0, share >= bound
    name = F.coalesce(F.concat(F.lit("="), "_source"), F.lit(""))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), name)), 1, 8), 16, 10).cast("long") % OFFSETS
    return sources.select(
        "_source",
        "source_size",
        "weight",
        F.when(empty, F.lit(0.0)).when(full, (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * words).cast("double") / F.lit(float(shares))).alias("target"),
        F.when(empty, _decimal(0)).when(full, _decimal(most)).otherwise(share).cast("decimal(38,0)").alias("_above"),
        F.when(empty | full, _decimal(1)).otherwise(_decimal(F.col("source_size")) * _decimal(shares)).cast("decimal(38,0)").alias("_below"),
        drawn.alias("_offset"),
    )


def allot(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, source, size and more) with ``source_size``, ``target`` and ``copies``."""
    others = [c for c in rows.columns if c not in ("source_size", "target", "copies")]
    row = F.struct(*others)
    keyed = rows.select(row.alias("_row"), F.col("source").alias("_source"), F.col("size"), F.col("doc_id").alias("_id"))
    hashed = [F.col("_row")[f.name] for f in rows.schema.fields if f.name in others and "map<" not in f.dataType.simpleString()]
    keyed = keyed.withColumn("_tie", F.xxhash64(*hashed)).withColumn("_uid", F.monotonically_increasing_id())
    keyed = stage(keyed, "sized")
    # equal rows may go in any order; the last key lets them lie in several ranges
    order = [F.col("_source").asc_nulls_last(), F.col("size"), F.col("_id"), F.col("_tie"), F.col("_uid")]
    placed = numbered(keyed, order, "in-order")
    firsts = placed.groupBy("_source").agg(F.min("position").alias("_first"))
    known = targets(keyed, weights, most, seed)
    lookup = known.join(firsts, known["_source"].eqNullSafe(firsts["_source"])).drop(firsts["_source"])
    key = F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")).alias("_key")  # null joins null
    lookup = stage(lookup.select(key, "source_size", "target", "_above", "_below", "_offset", "_first"), "targets")
    joined = attach(placed.select("_row", "position", "_uid", key), lookup, "_key", spread=F.col("_uid"))
    at = F.col("position") - F.col("_first")
    crossed = lambda i: f"cast(({i} * _above * {OFFSETS} + _below * _offset) div (_below * {OFFSETS}) as long)"
    counted = joined.withColumn("_i", _decimal(at)).withColumn("_j", _decimal(at + 1))
    counted = counted.withColumn("copies", F.expr(f"{crossed('_j')} - {crossed('_i')}"))
    return counted.select(*[F.col("_row")[c].alias(c) for c in others], "source_size", "target", "copies")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document of ``docs`` (doc_id, source, text and more) once per copy, numbered from 1 in ``copy``."""
    kept = [c for c in docs.columns if c != "copy"]
    taken = allot(with_size(docs), weights, most, seed).where("copies > 0")
    return taken.select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
