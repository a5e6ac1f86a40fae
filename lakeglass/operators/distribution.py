"""Distributions: statistics, histograms, box plots, outliers, correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.stats import bin_of, correlation, fences, share
from ..plans.compile import apply_filters, fresh, kind_of, label_of, number, quoted
from ..plans.requests import FilterSet, need

# The reported percentiles, and Tukey's factor.
PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
FENCE = 1.5
#: Most groups of a box chart: two rows for each of their quartiles are broadcast.
MAX_BOXES = 1000


def distribution_stats(df: DataFrame, column: str, filters: FilterSet | None = None) -> DataFrame:
    """One row: n, mean, median, min, max, standard deviation and exact percentiles."""
    v = number(df, column)
    rows = apply_filters(df, filters).select(v.alias("v")).where("v IS NOT NULL")
    out = rows.agg(F.count("v").alias("n"), F.avg("v").alias("mean_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.stddev_samp("v").alias("std_dev"))
    out = out.join(F.broadcast(quantiles(rows, [], "v", PERCENTILES, few=True).select(F.col("q").alias("p"))))  # both one row
    named = [F.col("p")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(PERCENTILES)]
    return out.select("n", "mean_value", F.col("p")[PERCENTILES.index(0.50)].alias("median_value"), "min_value", "max_value", "std_dev", *named)


def histogram(df: DataFrame, column: str, bins: int = 10, filters: FilterSet | None = None) -> DataFrame:
    """bin, lower, upper, n: equal-width bins, closed on the right; the first holds the minimum, and empty ones count 0.

    The bounds are one row; the counts are pre-aggregated on each executor.
    """
    need(2 <= bins <= 100, "2 to 100 bins")
    rows = apply_filters(df, filters).select(number(df, column).alias("v")).where("v IS NOT NULL")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo IS NOT NULL")
    binned = rows.join(F.broadcast(ends)).select(bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"))  # ends: one row
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    axis = ends.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return axis.join(counts, "bin", "left").select("bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("lower"), (F.col("lo") + width * F.col("bin")).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, column: str, group: str | None = None, limit: int = 20) -> DataFrame:
    """label, quartiles, whiskers (the extreme values inside the fences), outliers and n, by group in label order.

    The first groups are found before their quartiles, which are a row a group and joined back to the rows.
    """
    need(1 <= limit <= MAX_BOXES, f"1 to {MAX_BOXES} groups")
    key = label_of(quoted(group)) if group else F.lit("all")
    rows = df.select(key.alias("label"), number(df, column).alias("v")).where("v IS NOT NULL")
    if group:
        first = [r["label"] for r in rows.select("label").distinct().orderBy("label").limit(limit + 1).collect()]
        rows = rows.where(F.col("label").isin(first[:limit])) if len(first) > limit else rows
    q = quantiles(rows, ["label"], "v", (0.25, 0.5, 0.75), few=True).select("label", "q")
    low, high = fences(F.col("q")[0], F.col("q")[2], FENCE)
    inside = F.col("v").between(low, high)
    out = rows.join(F.broadcast(q), "label").groupBy("label").agg(F.first("q").alias("q"), F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"), F.count("*").alias("n"))
    return out.select("label", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median_value"), F.col("q")[2].alias("q3"), "whisker_low", "whisker_high", "outliers", "n")


def bounds(df: DataFrame, v: Column, method: str, threshold: float) -> DataFrame:
    """One row with lo and hi, beyond which a value is an outlier; null where the values do not spread."""
    need(method in ("iqr", "zscore") and 0 < threshold <= 10, "method 'iqr' or 'zscore', threshold over 0 and up to 10")
    if method == "iqr":
        q = quantiles(df.select(v.alias("v")), [], "v", (0.25, 0.75), few=True)
        low, high = fences(F.col("q")[0], F.col("q")[1], threshold)
        spread = F.col("q")[1] - F.col("q")[0]
        return q.select(F.when(spread > 0, low).alias("lo"), F.when(spread > 0, high).alias("hi"))
    s = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    return s.select(F.when(F.col("s") > 0, F.col("m") - threshold * F.col("s")).alias("lo"), F.when(F.col("s") > 0, F.col("m") + threshold * F.col("s")).alias("hi"))


def outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """One row: n, outliers and their share, the bounds, and the five-number summary. Strictly beyond a bound counts."""
    need(method in ("iqr", "zscore") and 0 < threshold <= 10, "method 'iqr' or 'zscore', threshold over 0 and up to 10")
    rows = df.select(number(df, column).alias("v")).where("v IS NOT NULL")
    five = quantiles(rows, [], "v", (0.0, 0.25, 0.5, 0.75, 1.0), few=True).select(F.col("q").alias("p"))
    five = five.join(F.broadcast(rows.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))))  # both one row
    low, high = fences(F.col("p")[1], F.col("p")[3], threshold) if method == "iqr" else (F.col("m") - threshold * F.col("s"), F.col("m") + threshold * F.col("s"))
    spread = F.col("p")[3] - F.col("p")[1] if method == "iqr" else F.col("s")
    b = five.select("p", F.when(spread > 0, low).alias("lo"), F.when(spread > 0, high).alias("hi"))
    beyond = F.coalesce((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")), F.lit(False))
    out = rows.join(F.broadcast(b)).agg(F.count("*").alias("n"), F.count_if(beyond).alias("outliers"), F.first("lo").alias("lower_bound"), F.first("hi").alias("upper_bound"), F.first("p").alias("p"))  # b: one row
    return out.select("n", "outliers", share(F.col("outliers"), F.col("n")).alias("outlier_pct"), "lower_bound", "upper_bound", *(F.col("p")[i].alias(a) for i, a in enumerate(("min_value", "q1", "median_value", "q3", "max_value"))))


def outlier_rows(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """The rows whose value lies beyond the bounds."""
    v = number(df, column)
    lo, hi = fresh(df, "lo"), fresh(df, "hi")
    b = bounds(df, v, method, threshold).select(F.col("lo").alias(lo), F.col("hi").alias(hi))
    return df.join(F.broadcast(b)).where((v < F.col(lo)) | (v > F.col(hi))).drop(lo, hi)  # b: one row


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """left_column, right_column, r, n for each pair of usable columns: pairwise complete, all in one pass.

    Columns with fewer than two values, or that do not vary, are left out.
    """
    for c in columns:
        kind_of(df, c)
    pairs = list(combinations(columns, 2))
    need(pairs, "at least two columns")
    cells = []
    for a, b in pairs:
        x, y = number(df, a), number(df, b)
        n = F.count_if(x.isNotNull() & y.isNotNull())
        cells.append(F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), correlation(x, y).alias("r"), n.alias("n")))
    one = df.agg(*(c.alias(f"p{i}") for i, c in enumerate(cells)))
    long = one.select(F.explode(F.array(*(F.col(f"p{i}") for i in range(len(pairs))))).alias("x")).select("x.*")
    return long.where("r IS NOT NULL")


def correlation_exclusions(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, reason for each column that the matrix leaves out."""
    stats = df.agg(*(F.struct(F.lit(c).alias("column"), F.count(number(df, c)).alias("n"), F.min(number(df, c)).alias("lo"), F.max(number(df, c)).alias("hi")).alias(f"s{i}") for i, c in enumerate(columns)))
    long = stats.select(F.explode(F.array(*(F.col(f"s{i}") for i in range(len(columns))))).alias("x")).select("x.*")
    return long.select("column", F.when(F.col("n") < 2, "fewer than two values").when(F.col("lo") == F.col("hi"), "constant").alias("reason")).where("reason IS NOT NULL")
