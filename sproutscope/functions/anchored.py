"""Time windows measured from an anchor timestamp such as a repository's creation."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sproutscope import schemas as S

__all__ = ["AnchoredWindow", "first_days", "first_months", "whole_days", "EARLY", "EARLY_CALENDAR", "LABEL"]


@dataclass(frozen=True)
class AnchoredWindow:
    """``anchor + start <= ts`` and ``ts <= anchor + end`` (``<`` when the end is open)."""

    start: str
    end: str
    closed_end: bool = True

    def opens(self, anchor: Column) -> Column:
        return anchor + F.expr(f"INTERVAL {self.start}")

    def closes(self, anchor: Column) -> Column:
        return anchor + F.expr(f"INTERVAL {self.end}")

    def contains(self, ts: Column, anchor: Column) -> Column:
        closes = self.closes(anchor)
        return (ts >= self.opens(anchor)) & (ts <= closes if self.closed_end else ts < closes)


def first_days(days: int) -> AnchoredWindow:
    """The first ``days`` days to the second, both ends included."""
    return AnchoredWindow("'0' DAY", f"'{days}' DAY")


def first_months(months: int) -> AnchoredWindow:
    """The first ``months`` calendar months, both ends included."""
    return AnchoredWindow("'0' MONTH", f"'{months}' MONTH")


def whole_days(lo: int, hi: int) -> AnchoredWindow:
    """Elapsed time whose floor in whole days lies in ``[lo, hi]``."""
    return AnchoredWindow(f"'{lo}' DAY", f"'{hi + 1}' DAY", closed_end=False)


EARLY = first_days(S.EARLY_DAYS)
EARLY_CALENDAR = first_months(S.EARLY_MONTHS)
LABEL = whole_days(S.LABEL_FIRST_DAY, S.LABEL_LAST_DAY)
