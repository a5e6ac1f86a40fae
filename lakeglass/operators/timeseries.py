"""Calendar time series: buckets, gap filling, growth, movement of groups, seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_timestamp, bucket, label, spine
from ..functions.stats import change
from ..plans.compile import kind_of, label_of, quoted
from ..plans.grouping import grouped
from ..plans.requests import Metric, need

MAX_POINTS = 500


def when_of(df: DataFrame, date_column: str) -> Column:
    kind = kind_of(df, date_column)
    need(kind in ("date", "timestamp", "timestamp_ntz", "string"), f"{date_column!r} holds no dates")
    return as_timestamp(quoted(date_column), kind)


def time_series(df: DataFrame, date_column: str, period: str, m: Metric, max_points: int = MAX_POINTS) -> DataFrame:
    """bucket, label, value for every period from the first to the last; the latest max_points of them.

    Rows without a date are left out. Periods without rows count 0; their other metrics are null. The aggregation runs on all
    executors; only the calendar, at most one row a period, is joined to it.
    """
    need(2 <= max_points <= 2000, "2 to 2000 points")
    found = df.withColumn("bucket", bucket(when_of(df, date_column), period)).where(F.col("bucket").isNotNull())
    return gap_filled(grouped(found, {"bucket": F.col("bucket")}, {"value": m}), period, m, max_points)


def gap_filled(found: DataFrame, period: str, m: Metric, max_points: int = MAX_POINTS) -> DataFrame:
    """bucket, label, value for every period from the first to the last bucket of `found` (bucket, value)."""
    ends = found.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo IS NOT NULL")
    axis = ends.select(F.explode(spine(F.col("lo"), F.col("hi"), period)).alias("bucket"))
    value = F.coalesce("value", F.lit(0.0)) if m.name in ("count", "distinct_count") else F.col("value")
    full = axis.join(found, "bucket", "left").select("bucket", label(F.col("bucket"), period).alias("label"), value.alias("value"))
    return full.orderBy(F.desc("bucket")).limit(max_points)


def grouped_series(df: DataFrame, date_column: str, period: str, m: Metric, group: str) -> DataFrame:
    """bucket, label, series, value: one series for each value of a column, observed periods only."""
    kind_of(df, group)
    rows = df.withColumn("bucket", bucket(when_of(df, date_column), period)).where(F.col("bucket").isNotNull())
    out = grouped(rows, {"bucket": F.col("bucket"), "series": label_of(quoted(group))}, {"value": m})
    return out.select("bucket", label(F.col("bucket"), period).alias("label"), "series", "value")


def growth(df: DataFrame, date_column: str, period: str, m: Metric, max_points: int = MAX_POINTS) -> DataFrame:
    """A time series with each point's predecessor, absolute and per cent change. The window sees one row a period."""
    points = time_series(df, date_column, period, m, max_points)
    before = F.lag("value").over(Window.orderBy("bucket"))
    out = points.withColumn("previous_value", before)
    return out.select("bucket", "label", "value", "previous_value", (F.col("value") - F.col("previous_value")).alias("change_value"), change(F.col("value"), F.col("previous_value")).alias("change_pct"))


def period_for(df: DataFrame, date_column: str) -> str:
    """The period that suits a date column's span: up to 31 days day, 120 week, 1095 month, else quarter."""
    t = when_of(df, date_column)
    return period_of(df.agg(F.datediff(F.max(t), F.min(t)).alias("d")).first()["d"], date_column)


def period_of(days: int | None, date_column: str) -> str:
    need(days is not None, f"{date_column!r} has no dates")
    return "day" if days <= 31 else "week" if days <= 120 else "month" if days <= 1095 else "quarter"


def dimension_movement(df: DataFrame, date_column: str, period: str, m: Metric, dimension: str) -> DataFrame:
    """label, latest_value, previous_value, change_pct: each group in the last two observed periods."""
    return movement(grouped_series(df, date_column, period, m, dimension))


def movement(series: DataFrame) -> DataFrame:
    """dimension_movement() of a series by group (bucket, series, value)."""
    # the observed periods are few: one row each
    ranked = series.select("bucket").distinct().withColumn("age", F.row_number().over(Window.orderBy(F.desc("bucket")))).where("age <= 2")
    cells = series.join(F.broadcast(ranked), "bucket")
    out = cells.groupBy("series").agg(F.max(F.when(F.col("age") == 1, F.col("value"))).alias("latest_value"), F.max(F.when(F.col("age") == 2, F.col("value"))).alias("previous_value"))
    return out.select(F.col("series").alias("label"), "latest_value", "previous_value", change(F.col("latest_value"), F.col("previous_value")).alias("change_pct"))


def seasonality(df: DataFrame, date_column: str, column: str) -> DataFrame:
    """month, mean_value, n, lift_pct: the mean of each calendar month against the mean of the twelve means.

    Empty where there are fewer than 24 distinct months. The best month is a season if its lift is at least 20.
    """
    from ..plans.compile import number

    t = when_of(df, date_column)
    rows = df.select(F.date_trunc("month", t).alias("m"), number(df, column).alias("v")).where("m IS NOT NULL AND v IS NOT NULL")
    return season(rows.groupBy("m").agg(F.sum("v").alias("s"), F.count("v").alias("k")))


def season(by_month: DataFrame) -> DataFrame:
    """seasonality() of monthly sums (m, s of k values)."""
    out = by_month.groupBy(F.month("m").alias("month")).agg((F.sum("s") / F.sum("k")).alias("mean_value"), F.sum("k").alias("n"), F.count("*").alias("months"))
    whole = Window.partitionBy()
    out = out.withColumn("all_months", F.sum("months").over(whole)).withColumn("mean_of_means", F.avg("mean_value").over(whole)).where("all_months >= 24")
    return out.select("month", "mean_value", "n", change(F.col("mean_value"), F.col("mean_of_means")).alias("lift_pct"))


def trends(df: DataFrame, date_column: str, period: str, wanted: dict[str, Metric]) -> DataFrame:
    """For each named metric: first and last value, change, direction, peak and trough over the observed periods, in one pass."""
    rows = df.withColumn("bucket", bucket(when_of(df, date_column), period)).where(F.col("bucket").isNotNull())
    cells = grouped(rows, {"bucket": F.col("bucket")}, {f"m{i}": m for i, m in enumerate(wanted.values())})
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"m{i}").alias("value")) for i, n in enumerate(wanted)))
    return trend_ends(cells.select("bucket", F.explode(pairs).alias("x")).select("bucket", "x.name", "x.value").where("value IS NOT NULL"), period)


def trend_ends(long: DataFrame, period: str) -> DataFrame:
    """trends() of series by name (bucket, name, value)."""
    ends = long.groupBy("name").agg(
        F.count("*").alias("periods"),
        F.min_by("value", "bucket").alias("first_value"),
        F.max_by("value", "bucket").alias("last_value"),
        F.max(F.struct("value", "bucket")).alias("peak"),
        F.min(F.struct("value", "bucket")).alias("trough"),
    )
    moved = change(F.col("last_value"), F.col("first_value"))
    # fixed values: at least 3 periods; within 5 per cent counts as stable
    direction = F.when(F.col("periods") < 3, "insufficient_data").when(moved.isNull(), "stable").when(moved > 5, "increasing").when(moved < -5, "decreasing").otherwise("stable")
    return ends.select("name", "periods", "first_value", "last_value", moved.alias("change_pct"), direction.alias("direction"), label(F.col("peak.bucket"), period).alias("peak_label"), F.col("peak.value").alias("peak_value"), label(F.col("trough.bucket"), period).alias("trough_label"), F.col("trough.value").alias("trough_value"))
