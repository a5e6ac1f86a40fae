"""Calendar buckets, their labels, and dates in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The periods of the request surface, and the shape that text must have to count as a date.
PERIODS = ("day", "week", "month", "quarter", "year")
DATE_SHAPE = r"(?:\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4})|(?:\d{1,2}\s*[A-Za-z]{3,})|(?:[A-Za-z]{3,}\s*\d{1,2})"
NUMBER_SHAPE = r"^[-+]?\d*\.?\d+$"
DATE_SHARE, DATE_LEAST = 0.9, 5

#: Formats that text dates are read by, in order; month first, as ISO is not ambiguous.
FORMATS = ("yyyy-M-d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d.M.yyyy", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy")
#: What any text that one of them fits begins with: a number and then nothing or a separator, or a month and a number.
POSSIBLE = r"^(?:[-+]?\d{1,6}(?:[-/.T :].*)?|\d{1,2} [A-Za-z]{3}\b.*|[A-Za-z]{3} \d.*)$"

_STEP = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR"}


def check_period(period: str) -> str:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, not {period!r}")
    return period


def parse_date(c: Column) -> Column:
    """A timestamp from text by the first format that fits, else null."""
    text = F.trim(c.cast("string"))
    # a format that does not fit costs an exception; most text cannot fit any
    return F.when(text.rlike(POSSIBLE), _by_format(text))


def _by_format(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS), F.try_to_timestamp(text))


def as_timestamp(c: Column, kind: str) -> Column:
    """A column of Spark type `kind` as a timestamp: typed dates are cast, text is parsed, anything else is null."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp")
    return parse_date(c) if kind == "string" else F.lit(None).cast("timestamp")


def bucket(ts: Column, period: str) -> Column:
    """The date that stands for a timestamp's period: its first day, or for a week the Sunday that ends it."""
    check_period(period)
    start = F.date_trunc(period, ts).cast("date")
    return F.date_add(start, 6) if period == "week" else start


def label(day: Column, period: str) -> Column:
    """2024-03-01, 2024-W09, 2024-03, 2024-Q1 or 2024. A week's year is that of its Sunday."""
    check_period(period)
    if period == "week":
        return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    if period == "quarter":
        return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    return F.date_format(day, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[period])


def spine(first: Column, last: Column, period: str) -> Column:
    """All buckets from first to last, as an array of dates."""
    return F.sequence(first, last, F.expr(_STEP[check_period(period)]))


def periods_between(first: Column, last: Column, period: str) -> Column:
    """How many periods lie between two buckets, as an integer."""
    if check_period(period) in ("day", "week"):
        return F.floor(F.datediff(last, first) / (7 if period == "week" else 1)).cast("int")
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[period]).cast("int")


def cohort_label(day: Column, period: str) -> Column:
    """2024-02, 2024Q1 or, for a week, its first and last day."""
    if period == "quarter":
        return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    if period == "week":
        return F.concat_ws("/", F.date_format(F.date_sub(day, 6), "yyyy-MM-dd"), F.date_format(day, "yyyy-MM-dd"))
    return label(day, period)
