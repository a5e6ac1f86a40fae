"""Chart data: categories with a rest, several series, scatter, and which charts suit a frame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compile import apply_filters, kind_of, label_of, number, quoted
from ..plans.grouping import aggregates
from ..plans.requests import Aggregate, FilterSet, need
from .distribution import box_stats, histogram

# Points of a scatter chart, distinct values of a category worth a chart, suggestions.
SCATTER_POINTS, CATEGORY_VALUES, SUGGESTIONS = 2000, 50, 8
#: Most categories of a chart: what a window then puts in order.
CATEGORY_ROWS = 1000
CHARTS = ("bar", "line", "area", "pie", "donut", "scatter", "histogram", "box")


def _measured(df: DataFrame, keys: dict[str, Column], y: str | None, function: str) -> DataFrame:
    return aggregates(df, keys, {"value": Aggregate(function, y) if y else Aggregate("count")})


def category_chart(df: DataFrame, x: str, y: str | None = None, function: str = "sum", max_categories: int = 20, by_label: bool = False) -> DataFrame:
    """position, label, value: the largest categories and 'Other' with the sum of the rest. Line charts go by label."""
    kind_of(df, x)
    groups = _measured(df, {"label": label_of(quoted(x))}, y, function).where("value IS NOT NULL").withColumn("value", F.col("value").cast("double"))
    need(1 <= max_categories <= CATEGORY_ROWS, f"1 to {CATEGORY_ROWS} categories")
    top = groups.orderBy(F.desc("value"), "label").limit(max_categories).withColumn("rest", F.lit(False))
    # top: max_categories rows; the rest is pre-aggregated where the groups are
    others = groups.join(F.broadcast(top.select("label")), "label", "left_anti").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    other = others.where("n > 0").select(F.lit("Other").alias("label"), "value", F.lit(True).alias("rest"))
    order = Window.orderBy("label", "rest") if by_label else Window.orderBy("rest", F.desc("value"), "label")
    return top.unionByName(other).select(F.row_number().over(order).cast("int").alias("position"), "label", "value")


def series_chart(df: DataFrame, x: str, group: str, y: str | None = None, function: str = "sum", max_series: int = 20) -> DataFrame:
    """label, series, value for the first groups (in label order) of a column; nulls have a series of their own."""
    kind_of(df, x), kind_of(df, group)
    cells = _measured(df, {"label": label_of(quoted(x)), "series": label_of(quoted(group))}, y, function).withColumn("value", F.col("value").cast("double"))
    first = cells.select("series").distinct().orderBy("series").limit(max_series)
    return cells.join(F.broadcast(first), "series").select("label", "series", "value")  # first: max_series rows


def pivot_chart(df: DataFrame, x: str, group: str, y: str | None = None, function: str = "sum", max_series: int = 20) -> DataFrame:
    """series_chart() with a column for each series."""
    cells = series_chart(df, x, group, y, function, max_series)
    names = [r["series"] for r in cells.select("series").distinct().orderBy("series").collect()]  # max_series rows
    return cells.groupBy("label").pivot("series", names).agg(F.first("value"))


def scatter_chart(df: DataFrame, x: str, y: str, order: str, points: int = SCATTER_POINTS) -> DataFrame:
    """x, y of the first complete pairs in an order."""
    kind_of(df, order)
    pairs = df.select(number(df, x).alias("x"), number(df, y).alias("y"), quoted(order).alias("o")).dropna(subset=["x", "y"])
    return pairs.orderBy("o", "x", "y").limit(points).select("x", "y")


def chart(df: DataFrame, kind: str, x: str | None = None, y: str | None = None, function: str = "sum", group: str | None = None, filters: FilterSet | None = None, limit: int = 20, bins: int = 10, order: str | None = None) -> DataFrame:
    """Data of any chart."""
    need(kind in CHARTS, f"unknown chart {kind!r}")
    rows = apply_filters(df, filters)
    need(not filters or not rows.isEmpty(), "no rows pass the filters")
    if kind == "histogram":
        return histogram(rows, x, bins)
    if kind == "box":
        return box_stats(rows, y, group, limit)
    if kind == "scatter":
        need(order, "a scatter chart needs an ordinal column")
        return scatter_chart(rows, x, y, order)
    if group and kind in ("bar", "line", "area"):
        return series_chart(rows, x, group, y, function, limit)
    return category_chart(rows, x, y, function, limit, kind in ("line", "area"))


def suggest_charts(columns: list[dict[str, Any]], limit: int = SUGGESTIONS) -> list[dict[str, Any]]:
    """Charts that suit a frame, from describe_columns(): trends, comparisons, relations, distributions, counts; each with a title and the reason for it.

    What is suggested depends on the kinds of columns there are, in the frame's order; groups are text or flags of up to CATEGORY_VALUES values.
    """
    numbers = [c["column"] for c in columns if c["numeric"]]
    dates = [c["column"] for c in columns if c["temporal"]]
    groups = [c["column"] for c in columns if c["type"] in ("string", "boolean") and 0 < (c["distinct"] or 0) <= CATEGORY_VALUES]
    out: list[dict[str, Any]] = []

    def add(kind: str, title: str, reason: str, **config: Any) -> None:
        out.append({"kind": kind, **config, "title": title, "reason": reason})

    if dates and numbers:
        add("line", f"{numbers[0]} over {dates[0]}", "values with dates make a trend", x=dates[0], y=numbers[0], function="sum")
    if groups and numbers:
        add("bar", f"{numbers[0]} by {groups[0]}", "groups are compared by a value's total", x=groups[0], y=numbers[0], function="sum")
    if len(numbers) > 1:
        add("scatter", f"{numbers[1]} against {numbers[0]}", "two values of each row show how they relate", x=numbers[0], y=numbers[1])
    for c in numbers[:2]:
        add("histogram", f"How {c} is distributed", "one value shows where most rows lie", x=c)
        add("box", f"How far {c} spreads", "quartiles and fences show spread and outliers", y=c)
    for c in groups[:2]:
        add("bar", f"Rows by {c}", "a group alone is counted", x=c, function="count")
    return out[:limit]


def recommend(intent: str, rows: int) -> str:
    """The chart for a question's answer."""
    return "line" if intent == "timeseries" else "pie" if 0 < rows <= 6 else "bar"
