"""Joins of a large table to a per-key lookup, safe for large lookups and hot keys.

A lookup is broadcast only after its rows were counted. Beyond the bound a bitmap of its
keys, of bounded size, is broadcast instead and drops rows of other keys at the scan; what
is left is written once, counted by key and joined by a shuffle, in which keys holding more
than ``1/slices`` of the rows are spread over ``slices`` sub-keys. There are fewer than ``slices`` such keys, whatever the data, so the
list of hot keys and the replicated lookup rows are bounded too.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sproutscope.session import stage

BROADCAST_ROWS = 1_000_000
#: Words of 64 bits in the bitmap of a lookup's keys, 8 MB of bits.
FILTER_WORDS = 1 << 20


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; never reads more than it has to."""
    return df.limit(max_rows + 1).count() <= max_rows


def slices_of(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def key_filter(big: DataFrame, lookup: DataFrame, on: list[str], words: int = FILTER_WORDS) -> DataFrame:
    """The rows of ``big`` whose key may be in ``lookup``: all that are, and few others.

    A key sets one bit of at most ``64 * words``. The words are broadcast, so rows are tested
    before any shuffle; a lookup of ``n`` keys lets through about ``n / (64 * words)`` of the rest.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(64 * words))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    placed = lookup.select(place.alias("_place")).distinct()
    bitmap = placed.groupBy(F.expr("_place div 64").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = big.withColumn("_place", place).withColumn("_word", F.expr("_place div 64"))
    # bounded: ``words`` rows
    met = marked.join(F.broadcast(bitmap), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return met.drop("_word", "_bits", "_place")


def hot_keys(big: DataFrame, on: list[str], slices: int) -> DataFrame:
    """Keys holding more than ``1/slices`` of the rows, as a literal table (< ``slices`` rows).

    One pass over ``big``: rows are counted per key, the counts are staged, and their sum is
    the total.
    """
    counted = stage(big.groupBy(*on).agg(F.count("*").alias("_rows")), "rows-per-key")
    total = counted.agg(F.sum("_rows")).first()[0] or 0
    found = counted.where(F.col("_rows") > total / slices).select(*on).collect()
    schema = big.select(*on).schema
    return big.sparkSession.createDataFrame(found, schema)


def spread_join(
    big: DataFrame, lookup: DataFrame, on: list[str], spread: Column, slices: int | None = None
) -> DataFrame:
    """Inner shuffle join of the rows that :func:`key_filter` leaves; their hot keys are split by ``spread``."""
    slices = slices or slices_of(big)
    matching = key_filter(big.withColumn("_spread", F.xxhash64(spread)), lookup, on)
    big = stage(matching, "matching")
    hot = F.broadcast(hot_keys(big, on, slices).withColumn("_hot", F.lit(True)))
    left = big.join(hot, on, "left").withColumn(
        "_slice", F.when(F.col("_hot"), F.pmod("_spread", F.lit(slices))).otherwise(F.lit(0))
    ).drop("_spread")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = lookup.join(hot, on, "left").withColumn("_slice", F.explode(copies)).drop("_hot")
    left = left.drop("_hot").withColumn("_slice", F.col("_slice").cast("int"))
    return left.join(right, [*on, "_slice"]).drop("_slice")


def attach(
    big: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    spread: Column,
    rows: int | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of ``big`` to a lookup with one row per key.

    ``rows`` is the counted size of the lookup when the caller knows it; ``spread`` is a
    column that differs between the rows of one key (an event id).
    """
    on = [on] if isinstance(on, str) else list(on)
    small = rows <= max_rows if rows is not None else fits(lookup, max_rows)
    if small:
        return big.join(F.broadcast(lookup), on)
    return spread_join(big, lookup, on, spread)
