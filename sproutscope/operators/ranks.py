"""Global order statistics without a global sort in one task.

Values are first collapsed to ``(value, tallies)``, so repeated values cost nothing. The
distinct values are dealt out by ranges, as many as the session's shuffle partitions; running
tallies are taken inside each range and shifted by the totals of the ranges before it, of
which there is one row per range and series.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sproutscope.session import stage


def running_tallies(
    df: DataFrame,
    value: str | Column,
    tallies: dict[str, Column],
    series: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Exact running sums over the ascending distinct values of each series.

    Returns ``(series, value, *tallies, before_*, total_*)``: the tallies of a value, their
    sums over all smaller values, and over the whole series. ``tallies`` are additive
    aggregates. Null values are left out. ``ranges`` sets the number of ranges.
    """
    value = F.col(value) if isinstance(value, str) else value
    series = F.lit("all") if series is None else series
    rows = df.withColumns({"series": series.cast("string"), "value": value.cast("double")}).where(
        F.col("value").isNotNull() & F.col("series").isNotNull()
    )
    distinct = rows.groupBy("series", "value").agg(
        *[tally.alias(name) for name, tally in tallies.items()]
    )
    keys = ["series", "value"]
    dealt = distinct.repartitionByRange(ranges, *keys) if ranges else distinct.repartitionByRange(*keys)
    # staged: the ranges must be the same for the totals and for the rows
    bucketed = stage(dealt.withColumn("_bucket", F.spark_partition_id()), "ranges")
    names = list(tallies)
    inside = (
        Window.partitionBy("series", "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = (
        Window.partitionBy("series").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("series")
    offsets = (
        bucketed.groupBy("series", "_bucket")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            "series",
            "_bucket",
            *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_ahead_{n}") for n in names],
            *[F.sum(n).over(whole).alias(f"total_{n}") for n in names],
        )
    )
    local = bucketed.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_local_{n}") for n in names]
    )
    # a row per range and series that meet grows with the series, so how to join it is left to its size at run time
    return local.join(offsets, ["series", "_bucket"]).select(
        "series",
        "value",
        *names,
        *[(F.col(f"_ahead_{n}") + F.col(f"_local_{n}")).alias(f"before_{n}") for n in names],
        *[F.col(f"total_{n}") for n in names],
    )


def medians(df: DataFrame, value: str | Column, series: Column | None = None) -> DataFrame:
    """Exact median per series: ``(series, n, median)``, nulls left out."""
    placed = running_tallies(df, value, {"rows": F.count("*")}, series)
    lower = F.expr("(total_rows - 1) div 2")
    upper = F.expr("total_rows div 2")
    at = lambda position: F.max(
        F.when(
            (F.col("before_rows") <= position) & (position < F.col("before_rows") + F.col("rows")),
            F.col("value"),
        )
    )
    return placed.groupBy("series").agg(
        F.max("total_rows").alias("n"), ((at(lower) + at(upper)) / 2).alias("median")
    )


def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns, one scalar each."""
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column", "cell"
    )
    found = {row["series"]: row["median"] for row in medians(long, "cell", F.col("column")).collect()}
    return {name: found.get(name) for name in cols}
