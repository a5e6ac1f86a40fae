"""Requests to Column expressions: filters, metrics and aggregations. Nothing here starts a job."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_timestamp
from ..functions.stats import all_of, any_of, clean_number
from .requests import NUMERIC_METRICS, Aggregate, Condition, FilterSet, Metric, need

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
_DATES = ("date", "timestamp", "timestamp_ntz")


def kind_of(df: DataFrame, column: str) -> str:
    """The Spark type of a column; unknown columns are refused."""
    kinds = dict(df.dtypes)
    need(column in kinds, f"unknown column {column!r}")
    return kinds[column]


def is_number(kind: str) -> bool:
    return kind in _NUMBERS or kind.startswith("decimal")


def is_date(kind: str) -> bool:
    return kind in _DATES


def quoted(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def resolve(df: DataFrame, name: str) -> str:
    """A column by name: the exact one, else the one that matches without case and blanks."""
    if name in df.columns:
        return name
    found = [c for c in df.columns if c.strip().lower() == name.strip().lower()]
    need(found, f"unknown column {name!r}")
    return found[0]


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _moment(value: Any, kind: str) -> Column:
    """A date value as a constant of a date column's own type, so that Parquet can be asked for it; null if it is none."""
    at = F.lit(value).cast("timestamp") if isinstance(value, dt.datetime | dt.date) else as_timestamp(F.lit(str(value)), "string")
    return at.cast(kind) if kind == "timestamp_ntz" else at


def _amount(value: Any) -> float | int | None:
    """A number, whole if it is; None if it is none."""
    if isinstance(value, int):
        return int(value)
    try:
        found = float(value)
    except (TypeError, ValueError):
        return None
    return int(found) if math.isfinite(found) and found.is_integer() else found


def _constant(amount: float | int, kind: str) -> Column:
    return F.lit(Decimal(str(amount))) if kind.startswith("decimal") and math.isfinite(amount) else F.lit(amount)


def _compared(c: Column, kind: str, op: str, value: Any) -> Column:
    """c op value, bare and with a constant of the column's type, as only that reaches the scan. NaN is over nothing."""
    if is_date(kind):
        left, right = c.cast("timestamp") if kind == "date" else c, _moment(value, kind)
    else:
        amount = _amount(value)
        if amount is None or amount != amount:
            return F.lit(False)
        if kind in _WHOLE and not isinstance(amount, int):
            if math.isinf(amount):
                return F.lit((amount > 0) == op.startswith("less")) & c.isNotNull()
            # between two whole numbers: over it is over the lower one, under it is under the upper one
            amount, op = (math.floor(amount), "greater_than") if op.startswith("greater") else (math.ceil(amount), "less_than")
        left, right = c, _constant(amount, kind)
    found = {"greater_than": left > right, "greater_or_equal": left >= right, "less_than": left < right, "less_or_equal": left <= right}[op]
    return found & ~F.isnan(c) if kind in ("float", "double") and op.startswith("greater") else found


def _same(c: Column, kind: str, value: Any) -> tuple[Column, Column] | None:
    """Both sides of an equality: typed for numbers (deviation: 1.0 equals 1), by text otherwise. None: nothing can be equal."""
    if is_number(kind):
        amount = _amount(value)
        whole = isinstance(amount, int) and abs(amount) < 2**63
        return None if amount is None or (kind in _WHOLE and not whole) else (c, _constant(amount, kind))
    if kind == "boolean":
        return (c, F.lit(str(value).lower() == "true")) if str(value).lower() in ("true", "false") else None
    if is_date(kind):
        return c.cast("timestamp") if kind == "date" else c, _moment(value, kind)
    return c.cast("string"), F.lit(str(value))


def condition(df: DataFrame, cond: Condition) -> Column:
    """One condition as a Boolean column. It may be null where the column is, which counts as false in where() and when(), under OR too."""
    kind, c, op = kind_of(df, cond.column), quoted(cond.column), cond.op
    if op == "is_null":
        return c.isNull() | F.isnan(c) if kind in ("float", "double") else c.isNull()
    if op == "is_not_null":
        return c.isNotNull() & ~F.isnan(c) if kind in ("float", "double") else c.isNotNull()
    if op in ("equals", "not_equals"):
        sides = _same(c, kind, cond.value)
        if op == "equals":
            return sides[0] == sides[1] if sides else F.lit(False)
        # null differs from every value; a value that is none of the column's (a null constant) differs from all
        return ~sides[0].eqNullSafe(sides[1]) | sides[1].isNull() if sides else F.lit(True)
    if op == "contains":
        return F.contains(F.lower(c.cast("string")), F.lower(F.lit(str(cond.value))))
    need(is_number(kind) or is_date(kind), f"{op} needs a number or a date, and {cond.column!r} is {kind}")
    if op != "between":
        return _compared(c, kind, op, cond.value)
    ends = [cond.value, cond.upper]
    if is_number(kind):
        amounts = [_amount(x) for x in ends]
        if None in amounts:
            return F.lit(False)
        ends = sorted(amounts)  # bounds in the wrong order are swapped
        return _compared(c, kind, "greater_or_equal", ends[0]) & _compared(c, kind, "less_or_equal", ends[1])
    low, high = (_moment(x, kind) for x in ends)
    left = c.cast("timestamp") if kind == "date" else c
    return left.between(F.least(low, high), F.greatest(low, high)) & low.isNotNull() & high.isNotNull()


def predicate(df: DataFrame, filters: FilterSet | None) -> Column | None:
    if not filters or not filters.conditions:
        return None
    parts = [condition(df, c) for c in filters.conditions]
    return all_of(parts) if filters.combine == "and" else any_of(parts)


def apply_filters(df: DataFrame, filters: FilterSet | None) -> DataFrame:
    p = predicate(df, filters)
    return df if p is None else df.where(p)


def merge_filters(*sets: FilterSet | None) -> FilterSet:
    """All conditions of several sets, which must all hold (deviation D8: an OR among the sets is not kept)."""
    return FilterSet(tuple(c for s in sets if s for c in s.conditions), "and")


def number(df: DataFrame, column: str) -> Column:
    """A column as double for metrics; null if it is no number."""
    kind = kind_of(df, column)
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return quoted(column).cast("double")
    return clean_number(quoted(column)) if kind in ("float", "double", "string") else F.lit(None).cast("double")


def held(df: DataFrame, m: Metric, c: Column, also: Column | None = None) -> Column:
    """c where a metric's own filters and `also` hold, null elsewhere."""
    own = predicate(df, m.filters)
    keep = own if also is None else also if own is None else own & also
    return c if keep is None else F.when(keep, c)


def is_median(df: DataFrame, m: Metric) -> bool:
    """Whether a metric is a median, which is no aggregate here (see grouping.py); refused for what is no number."""
    if m.name == "median":
        kind = kind_of(df, m.column)
        need(is_number(kind), f"median needs a number, and {m.column!r} is {kind}")
    return m.name == "median"


def metric(df: DataFrame, m: Metric, also: Column | None = None) -> Column:
    """A metric, other than a median, as an aggregate; a sum of nothing is null. A filtered metric sees only its own rows, of those that pass `also`."""
    if m.column is None:
        return F.count(held(df, m, F.lit(1), also)).cast("double")
    kind, raw = kind_of(df, m.column), held(df, m, quoted(m.column), also)
    need(is_number(kind) or m.name not in NUMERIC_METRICS, f"{m.name} needs a number, and {m.column!r} is {kind}")
    if m.name == "count":
        return F.count(raw).cast("double")
    if m.name == "distinct_count":
        return F.count_distinct(raw).cast("double")
    c = held(df, m, number(df, m.column), also)
    return {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "std_dev": F.stddev_samp, "range": lambda x: F.max(x) - F.min(x)}[m.name](c)


def aggregate(df: DataFrame, a: Aggregate) -> Column:
    """An aggregation of the generic query; here a sum of nothing is 0, and the extremes of dates are dates. Of a median it is the values."""
    if a.column is None:
        return F.count(F.lit(1))
    kind, c = kind_of(df, a.column), quoted(a.column)
    if a.function == "count":
        return F.count(c)
    need(is_number(kind) or (is_date(kind) and a.function in ("min", "max")), f"{a.function} does not apply to {a.column!r}, which is {kind}")
    if is_number(kind):
        c = number(df, a.column)
    return {"sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "mean": F.avg, "median": lambda x: x, "min": F.min, "max": F.max}[a.function](c)


def label_of(c: Column) -> Column:
    """A group's label: its text, '(empty)' for null."""
    return F.coalesce(c.cast("string"), F.lit("(empty)"))
