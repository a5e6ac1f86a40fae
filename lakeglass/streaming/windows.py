"""The calendar operators over streams: tumbling periods and sessions with watermarks, so that state is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.requests import need

WIDTHS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}


def windowed_series(stream: DataFrame, date_column: str, width: str, value: str | None = None, group: str | None = None, late: str = "1 day") -> DataFrame:
    """window_start, (series,) n, total for each period; a period is final when the watermark has passed it."""
    need(width in WIDTHS, f"width must be one of {tuple(WIDTHS)}")
    made = [F.count("*").alias("n")] + ([F.sum(F.col(value).cast("double")).alias("total")] if value else [])
    keys = [F.window("__at", WIDTHS[width])] + ([F.col(group).alias("series")] if group else [])
    out = stream.withColumn("__at", F.col(date_column).cast("timestamp")).withWatermark("__at", late).groupBy(*keys).agg(*made)
    return out.select(F.col("window.start").alias("window_start"), *(["series"] if group else []), "n", *(["total"] if value else []))


def sessions(stream: DataFrame, user: str, date_column: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user, session_start, session_end, n: runs of a user's events without a longer gap."""
    out = stream.withColumn("__at", F.col(date_column).cast("timestamp")).withWatermark("__at", late).groupBy(F.col(user).alias("user"), F.session_window("__at", gap)).agg(F.count("*").alias("n"))
    return out.select("user", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
