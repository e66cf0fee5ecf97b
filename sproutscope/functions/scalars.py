"""Column helpers. All of them stay inside whole-stage code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope import schemas as S

__all__ = [
    "json_scalar", "json_items", "strict_timestamp", "lenient_timestamp", "month_of",
    "month_prefix", "plus_months", "month_start", "hours_between", "whole_hours_between",
    "whole_days_between", "months_spanned", "safe_ratio", "per_week", "share_of_total",
    "is_present", "comma_list", "indicator", "interval_label", "feature_of_condition",
    "owner_and_name", "existing_columns", "prefer",
]

# The timestamp spelling of the archives.
ARCHIVE_TIME_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
ARCHIVE_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"


def json_scalar(text: Column, path: str) -> Column:
    """One scalar out of a JSON text; prefer one ``from_json`` when several are needed."""
    return F.get_json_object(text, path)


def json_items(text: Column, item: T.DataType) -> Column:
    """A JSON array text as an array column, ready for ``explode``."""
    return F.from_json(text, T.ArrayType(item))


def strict_timestamp(text: Column) -> Column:
    """Archive timestamp, null for any other spelling; independent of the session zone."""
    return F.when(
        text.rlike(ARCHIVE_TIME_SHAPE), F.try_to_timestamp(text, F.lit(ARCHIVE_TIME_FORMAT))
    )


def lenient_timestamp(text: Column) -> Column:
    """Any ISO-like timestamp, null when it cannot be read."""
    return F.try_to_timestamp(text)


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_prefix(text: Column) -> Column:
    return F.substring(text, 1, 7)


def plus_months(ts: Column, months: int) -> Column:
    return ts + F.expr(f"INTERVAL '{months}' MONTH")


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_seconds(end) - F.unix_seconds(start)) / F.lit(3600)


def whole_hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("HOUR", start, end)


def whole_days_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("DAY", start, end)


def months_spanned(start: Column, end: Column) -> Column:
    """Number of month boundaries between two dates."""
    return (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, null unless ``whole`` is positive."""
    return F.when(whole > 0, part / whole)


def per_week(total: Column, weeks: int = S.EARLY_WEEKS) -> Column:
    return total / F.lit(weeks)


def share_of_total(own: Column, other: Column) -> Column:
    """``own / (own + other)``; null when a side is unknown or both are zero."""
    return F.when((own + other) > 0, own / (own + other))


def is_present(value: Column) -> Column:
    return value.isNotNull()


def comma_list(items: Column) -> Column:
    return F.concat_ws(",", items)


def indicator(condition: Column) -> Column:
    """1 when the condition holds, else 0 (also for null)."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def prefer(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def interval_label(value: Column, bins=S.DIVERGENCE_BINS) -> Column:
    """Label of the interval ``(low, high]`` holding ``value``; null outside all of them."""
    ladder = None
    for low, high, label in bins:
        inside = (value > low) & (value <= high)
        ladder = F.when(inside, label) if ladder is None else ladder.when(inside, label)
    return ladder


def feature_of_condition(text: Column) -> Column:
    """Feature name out of a rule such as ``1.00 < stars <= 5.00``; the text itself if none."""
    pieces = F.transform(F.split(text, r"<=|>=|<|>|="), lambda piece: F.trim(piece))
    names = F.filter(pieces, lambda piece: ~piece.rlike(r"^[-+]?\d+(\.\d+)?$"))
    return F.coalesce(F.try_element_at(names, F.lit(1)), text)


def owner_and_name(full_name: Column) -> tuple[Column, Column]:
    """The halves of ``owner/name``, null unless there are exactly two."""
    parts = F.split(full_name, "/")
    exact = F.size(parts) == 2
    return F.when(exact, parts[0]), F.when(exact, parts[1])


def existing_columns(df, wanted=S.DATASET_COLUMNS):
    """Select the wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return df.select(*[name for name in wanted if name in present])
