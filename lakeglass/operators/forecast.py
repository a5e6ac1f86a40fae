"""Forecasts of a time series: Holt's linear trend, simple exponential smoothing, moving average; all in built-in functions.

The series is aggregated on all executors; smoothing then runs over one array of at most 2,000 periods, as each step needs the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.requests import Metric, need
from .timeseries import time_series

# Smoothing factors, trailing periods of the average, least history, quantile of the interval, band of a stable trend.
ALPHA, BETA, TRAILING, LEAST, QUANTILE, STABLE = 0.4, 0.2, 3, 6, 1.96, 0.01
METHODS = ("holt", "ses", "moving_average")


def _holt(v: Column) -> Column:
    """level, trend and fitted values. A fitted value is level plus trend after its own observation."""
    start = F.struct(v[0].alias("level"), (v[1] - v[0]).alias("trend"), F.array(v[0]).alias("fitted"))

    def step(s: Column, x: Column) -> Column:
        level = x * ALPHA + (s["level"] + s["trend"]) * (1 - ALPHA)
        trend = (level - s["level"]) * BETA + s["trend"] * (1 - BETA)
        return F.struct(level.alias("level"), trend.alias("trend"), F.array_append(s["fitted"], level + trend).alias("fitted"))

    return F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), start, step)


def _ses(v: Column) -> Column:
    start = F.struct(v[0].alias("level"), F.lit(0.0).alias("trend"), F.array(v[0]).alias("fitted"))

    def step(s: Column, x: Column) -> Column:
        level = x * ALPHA + s["level"] * (1 - ALPHA)
        return F.struct(level.alias("level"), F.lit(0.0).alias("trend"), F.array_append(s["fitted"], level).alias("fitted"))

    return F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), start, step)


def _moving(v: Column) -> Column:
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    fitted = F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: mean(F.slice(v, F.greatest(i - (TRAILING - 1), F.lit(1)), F.least(i, F.lit(TRAILING)))))
    return F.struct(F.element_at(fitted, -1).alias("level"), F.lit(0.0).alias("trend"), fitted.alias("fitted"))


def fitted_series(points: DataFrame, method: str) -> DataFrame:
    """One row: labels, v (values), level, trend, fitted, n, sigma, mae. points: bucket, label, value; null values are left out."""
    need(method in METHODS, f"unknown method {method!r}")
    one = points.where("value IS NOT NULL").agg(F.sort_array(F.collect_list(F.struct("bucket", "label", "value"))).alias("p"))
    one = one.select(F.transform("p", lambda x: x["label"]).alias("labels"), F.transform("p", lambda x: x["value"]).alias("v")).where(F.size("v") >= LEAST)
    made = {"holt": _holt, "ses": _ses, "moving_average": _moving}[method](F.col("v"))
    one = one.withColumn("s", made).select("labels", "v", "s.*")
    residual = one.withColumn("e", F.arrays_zip("v", "fitted")).withColumn("e", F.transform("e", lambda x: x["v"] - x["fitted"]))
    n = F.size("e")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(F.col("e")) / n
    residual = residual.withColumn("mean_e", mean)
    sigma = F.sqrt(total(F.transform("e", lambda x: F.pow(x - F.col("mean_e"), 2))) / (n - 1))
    return residual.select("labels", "v", "level", "trend", "fitted", n.alias("n"), sigma.alias("sigma"), (total(F.transform("e", F.abs)) / n).alias("mae"))


def forecast(df: DataFrame, date_column: str, period: str, m: Metric, method: str = "holt", horizon: int = 6) -> DataFrame:
    """step, value, lower_bound, upper_bound, trend, mae, periods for the next `horizon` periods; no rows for less than 6 periods."""
    need(1 <= horizon <= 60, "1 to 60 periods ahead")
    one = fitted_series(time_series(df, date_column, period, m, 2000), method)
    out = one.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = F.col("level") + F.col("trend") * F.col("step")
    spread = F.col("sigma") * F.sqrt("step") * QUANTILE
    trend = F.when(F.col("trend") > STABLE, "increasing").when(F.col("trend") < -STABLE, "decreasing").otherwise("stable")
    return out.select("step", value.alias("value"), (value - spread).alias("lower_bound"), (value + spread).alias("upper_bound"), trend.alias("trend"), "mae", F.col("n").alias("periods"))
