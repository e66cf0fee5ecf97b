"""From the dataset to model features: column choice, imputation, encoding."""

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope import schemas as S
from sproutscope.functions.scalars import indicator
from sproutscope.operators.ranks import column_medians
from sproutscope.session import stage
from sproutscope.sizing import BROADCAST_ROWS, attach

_LABELS = ("is_sustainable",)
#: Columns that a plan can still hold, and the driver the names of.
MOST_DUMMIES = 5000


def _split_types(df: DataFrame, skip=()) -> tuple[list[str], list[str], list[str]]:
    """Names of the numeric, text and boolean columns."""
    kinds = {T.NumericType: [], T.StringType: [], T.BooleanType: []}
    for field in df.schema.fields:
        for kind, names in kinds.items():
            if isinstance(field.dataType, kind) and field.name not in skip:
                names.append(field.name)
    return tuple(kinds.values())


def feature_columns(df: DataFrame, cohort: str = "fork") -> list[str]:
    dropped = set(S.NEVER_FEATURES)
    if cohort == "nonfork":
        dropped |= set(S.FORK_ONLY_FEATURES)
    elif cohort != "fork":
        raise ValueError(f"unknown cohort: {cohort}")
    return [c for c in df.columns if c not in dropped]


def feature_frame(df: DataFrame, cohort: str = "fork", keep=()) -> DataFrame:
    """Feature columns only (plus ``keep``); identifiers and, for non-forks, fork columns go."""
    return df.select(*keep, *feature_columns(df, cohort))


def impute_domain(df: DataFrame, skip=_LABELS) -> DataFrame:
    """Unanswered threads count as twice the median delay; any other missing number is 0.

    Booleans become 0/1; one that has nulls is a category like any text, with codes in the order
    False, True, null of those that occur. Text columns are left to the encoder.
    """
    numbers, _text, flags = _split_types(df, skip)
    doubled = [c for c in S.DOUBLED_MEDIAN_FEATURES if c in numbers]
    middle = column_medians(df, doubled)
    filled = {c: F.coalesce(F.col(c), F.lit(2 * middle[c])) for c in doubled if middle[c] is not None}
    filled |= {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in numbers if c not in filled}
    return df.withColumns(filled | _flag_codes(df, flags))


def _flag_codes(df: DataFrame, flags: list[str]) -> dict[str, Column]:
    """The code of each flag: 0/1, or its rank among False, True and null where there are nulls."""
    if not flags:
        return {}
    kinds = {"false": lambda c: ~c, "true": lambda c: c, "null": lambda c: c.isNull()}
    found = df.agg(*[F.coalesce(F.max(test(F.col(c))), F.lit(False)).alias(f"{i}_{k}") for i, c in enumerate(flags) for k, test in kinds.items()]).first()
    codes = {}
    for i, c in enumerate(flags):
        false, true = int(found[f"{i}_false"]), int(found[f"{i}_true"])
        code = F.when(F.col(c), false).when(~F.col(c), 0).otherwise(false + true)
        codes[c] = code if found[f"{i}_null"] else indicator(F.col(c))
    return codes


def _modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent value per column as text, the smallest on ties."""
    if not cols:
        return {}
    counts = _category_counts(df, cols)
    best = counts.groupBy("column").agg(
        F.min_by("category", F.struct(-F.col("count"), F.col("category"))).alias("mode")
    )
    return {row["column"]: row["mode"] for row in best.collect()}


def impute_generic(df: DataFrame, skip=_LABELS) -> DataFrame:
    """Numbers take the column's exact median, text and booleans its most frequent value."""
    numbers, text, flags = _split_types(df, skip)
    middle, modes = column_medians(df, numbers), _modes(df, text + flags)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in middle.items() if v is not None}
    filled |= {c: F.coalesce(F.col(c), F.lit(modes[c])) for c in text if c in modes}
    filled |= {c: F.coalesce(F.col(c), F.lit(modes[c] == "true")) for c in flags if c in modes}
    return df.withColumns(filled)


def label_encode(df: DataFrame, cols: list[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Text replaced by its rank in the alphabet of the column; null is the category ``nan``.

    Any number of categories: codes are ranked in Spark and joined back per column, beyond
    ``max_rows`` categories by a shuffle that splits a frequent one.
    """
    named = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols})
    codes = category_codes(named, cols)
    for i, c in enumerate(cols):
        own = codes.where(F.col("column") == c).select(F.col("category").alias(c), F.col("code").alias(f"_code_{i}"))
        named = attach(named, own, c, spread=F.struct(*[F.col(x) for x in df.columns if x != c]), max_rows=max_rows)
    order = [F.col(f"_code_{cols.index(c)}").cast("int").alias(c) if c in cols else F.col(c) for c in df.columns]
    return named.select(*order)


def category_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, category, code)``: the rank of each category in its column, from 0.

    Categories are dealt out by ranges, ranked inside each range, and shifted by the counts
    of the ranges before, of which there is one row per range and column.
    """
    ordered = _category_counts(df, cols).select("column", "category").repartitionByRange("column", "category")
    parts = stage(ordered.withColumn("part", F.spark_partition_id()), "categories")
    sizes = parts.groupBy("column", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("column", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("column", "part").orderBy("category"))
    ranked = parts.withColumn("place", inside).join(shifts, ["column", "part"])
    return stage(ranked.select("column", "category", (F.col("shift") + F.col("place") - 1).alias("code")), "codes")


def one_hot_vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column replaced by a sparse 0/1 vector over its categories in reverse alphabet, the first dropped.

    For columns with too many categories for a column each; null is the category ``nan``.
    """
    codes = [f"_code_{i}" for i in range(len(cols))]
    encoded = label_encode(df, cols).withColumnsRenamed(dict(zip(cols, codes, strict=True)))
    # from the end of the alphabet, as the encoder leaves out the last category and we the first
    most = encoded.agg(*[F.max(c).alias(c) for c in codes]).first()
    turned = encoded.withColumns({c: F.lit(most[c]) - F.col(c) for c in codes})
    made = OneHotEncoder(inputCols=codes, outputCols=cols, dropLast=True).fit(turned).transform(turned)
    return made.select(*df.columns)


def _category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, category, count)``, nulls left out."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return (
        text.unpivot([], cols, "column", "category")
        .where(F.col("category").isNotNull())
        .groupBy("column", "category")
        .agg(F.count("*").alias("count"))
    )


def dummy_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Category counts without each column's alphabetically first category."""
    counts = _category_counts(df, cols)
    first = counts.groupBy("column").agg(F.min("category").alias("first"))
    # bounded: one row per column
    return counts.join(F.broadcast(first), "column").where("category <> first").drop("first")


def top_categories(df: DataFrame, cols: list[str], n: int = 10) -> DataFrame:
    """The ``n`` most frequent dummy categories over all the columns together."""
    return dummy_counts(df, cols).orderBy(F.col("count").desc(), "column", "category").limit(n)


def one_hot(df: DataFrame, cols: list[str], kept: DataFrame | None = None) -> DataFrame:
    """Each column replaced by 0/1 columns ``column_category``, the first category dropped.

    ``kept`` (``column, category``) restricts the dummies, e.g. to :func:`top_categories`. Each
    becomes a column of the result; more than ``MOST_DUMMIES`` are refused, not cut:
    :func:`one_hot_vectors` takes any number.
    """
    chosen = dummy_counts(df, cols) if kept is None else kept
    found = chosen.select("column", "category").limit(MOST_DUMMIES + 1).collect()
    if len(found) > MOST_DUMMIES:
        raise ValueError(f"more than {MOST_DUMMIES} dummy columns: use one_hot_vectors")
    dummies = [
        indicator(F.col(c).cast("string") == category).alias(f"{c}_{category}")
        for c, category in sorted((row["column"], row["category"]) for row in found)
    ]
    return df.select(*[c for c in df.columns if c not in cols], *dummies)


def boosted_features(df: DataFrame, cohort: str, label: str = "is_sustainable") -> DataFrame:
    """Encoded and imputed features with key and label, for the cross-validated model."""
    frame = feature_frame(df, cohort, keep=("repo_name", label))
    _numbers, text, _flags = _split_types(frame, skip=("repo_name",))
    encoded = label_encode(frame, text) if text else frame
    return impute_domain(encoded, skip=("repo_name", label))


def dummy_features(df: DataFrame, cohort: str, label: str = "is_sustainable", languages: int = 10) -> DataFrame:
    """Imputed features with dummies, only the most frequent languages kept."""
    frame = impute_generic(feature_frame(df, cohort, keep=("repo_name", label)), skip=("repo_name", label))
    spoken = [c for c in ("primary_language", "parent_language") if c in frame.columns]
    _numbers, text, flags = _split_types(frame, skip=("repo_name", *spoken))
    plain = one_hot(frame, text + flags) if text or flags else frame
    return one_hot(plain, spoken, top_categories(frame, spoken, languages)) if spoken else plain
