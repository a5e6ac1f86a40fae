"""Customer analytics: RFM, cohorts, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket, cohort_label, periods_between
from ..functions.stats import quintile, share
from ..plans.compile import kind_of, number, quoted
from ..plans.requests import need
from .timeseries import when_of

# Fixed value: the least number of customers.
LEAST_CUSTOMERS = 10
# Segments by scores from 1 to 5, the first that fits. (least, most) of recency, frequency and monetary score.
SEGMENTS = (
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal Customers", (3, 5), (4, 5), (1, 5)),
    ("Potential Loyalists", (4, 5), (1, 3), (3, 5)),
    ("New Customers", (4, 5), (1, 2), (1, 5)),
    ("Can't Lose Them", (1, 2), (4, 5), (4, 5)),
    ("At Risk", (1, 3), (3, 5), (1, 5)),
    ("Lost", (1, 2), (1, 2), (1, 2)),
    ("Hibernating", (1, 3), (1, 5), (1, 5)),
)
OTHER_SEGMENT = "Others"


def _customers(df: DataFrame, customer: str, date: str, amount: str | None) -> DataFrame:
    kind_of(df, customer)
    rows = df.select(quoted(customer).alias("customer"), when_of(df, date).alias("at"), *([number(df, amount).alias("amount")] if amount else []))
    return rows.dropna()


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """The segment by scores from 1 to 5, the first that fits."""
    out = F.lit(OTHER_SEGMENT)
    for name, *bounds in reversed(SEGMENTS):
        fits = [score.between(*ends) for score, ends in zip((r, f, m), bounds, strict=True)]
        out = F.when(fits[0] & fits[1] & fits[2], name).otherwise(out)
    return out


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the position (from 1) of each row in an order, worked out in parallel.

    Rows are range-partitioned and numbered within each range; the ranges' sizes, one number each, are added up and joined.
    A window over the whole frame would sort all rows in one task.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    # a written copy, so that the parts are the same for both uses
    held = _written(ranged)
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # one row a partition
    return held.withColumn("__inner", inner).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__inner")).drop("__part", "__inner", "__before")


def _written(df: DataFrame) -> DataFrame:
    from ..sources.storage import written

    return written(df)


#: Customers up to this number are ranked by a plain window.
FEW_CUSTOMERS = 1_000_000


def rfm(df: DataFrame, customer: str, date: str, amount: str) -> DataFrame:
    """customer, recency_days, frequency, monetary, the three scores, segment.

    The reference date is the latest one in the data. Customers with a monetary value of 0 or less are left out; at least 10
    must be left. Scores are quintiles of the rank; ties go by customer.
    """
    rows = _customers(df, customer, date, amount)
    last = rows.agg(F.max("at").alias("ref"))
    by = rows.groupBy("customer").agg(F.max("at").alias("at"), F.count("*").alias("frequency"), F.sum("amount").alias("monetary")).where("monetary > 0")
    by = by.join(F.broadcast(last)).select("customer", F.floor((F.col("ref").cast("double") - F.col("at").cast("double")) / 86400).cast("int").alias("recency_days"), "frequency", "monetary")  # last: one row
    n = by.count()
    need(n >= LEAST_CUSTOMERS, f"RFM needs {LEAST_CUSTOMERS} customers with a positive value")
    scored = by
    for column, name in (("recency_days", "r"), ("frequency", "f"), ("monetary", "m")):
        order = [F.col(column), F.col("customer")]
        scored = scored.withColumn(f"{name}_rank", F.row_number().over(Window.orderBy(*order))) if n <= FEW_CUSTOMERS else ranked(scored, order, f"{name}_rank")
    score = lambda name: quintile(F.col(f"{name}_rank"), F.lit(n))
    scored = scored.withColumns({"r_score": 6 - score("r"), "f_score": score("f"), "m_score": score("m")})
    return scored.select("customer", "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score", rfm_segment(F.col("r_score"), F.col("f_score"), F.col("m_score")).alias("segment"))


def rfm_segments(scored: DataFrame) -> DataFrame:
    """segment, customers, value, customers_pct, value_pct, averages, of rfm()'s rows, the most valuable first."""
    out = scored.groupBy("segment").agg(F.count("*").alias("customers"), F.sum("monetary").alias("total_value"), F.avg("recency_days").alias("avg_recency"), F.avg("frequency").alias("avg_frequency"), F.avg("monetary").alias("avg_monetary"))
    whole = Window.partitionBy()
    out = out.withColumn("customers_pct", share(F.col("customers"), F.sum("customers").over(whole))).withColumn("value_pct", share(F.col("total_value"), F.sum("total_value").over(whole)))
    return out.orderBy(F.desc("total_value"), "segment")


def cohort_matrix(df: DataFrame, customer: str, date: str, period: str = "month", max_periods: int = 12) -> DataFrame:
    """cohort, label, period_offset, customers, retention_pct. Offsets without customers have no row."""
    need(2 <= max_periods <= 36 and period in ("week", "month", "quarter"), "2 to 36 periods of a week, month or quarter")
    rows = _customers(df, customer, date, None).select("customer", bucket(F.col("at"), period).alias("p")).distinct()
    first = rows.groupBy("customer").agg(F.min("p").alias("cohort"))
    # one exchange by customer serves the aggregate and the join
    placed = rows.join(first, "customer").withColumn("period_offset", periods_between(F.col("cohort"), F.col("p"), period))
    cells = placed.where(F.col("period_offset") < max_periods).groupBy("cohort", "period_offset").agg(F.count("*").alias("customers"))
    size = F.max(F.when(F.col("period_offset") == 0, F.col("customers"))).over(Window.partitionBy("cohort"))
    return cells.withColumn("size", size).select("cohort", cohort_label(F.col("cohort"), period).alias("label"), "period_offset", "customers", share(F.col("customers"), F.col("size")).alias("retention_pct"))


def cohort_average(cells: DataFrame) -> DataFrame:
    """period_offset, retention_pct: the mean over the cohorts that have customers at that offset."""
    return cells.groupBy("period_offset").agg(F.avg("retention_pct").alias("retention_pct"), F.count("*").alias("cohorts"))


def churn_customers(df: DataFrame, customer: str, date: str, amount: str | None = None, at_risk_days: int = 45, churn_days: int = 90) -> DataFrame:
    """customer, last_date, inactive_days, value, status (active, at_risk, churned) against the latest date in the data."""
    need(0 < at_risk_days < churn_days, "at-risk days must be fewer than churn days")
    rows = _customers(df, customer, date, None) if not amount else df.select(quoted(customer).alias("customer"), when_of(df, date).alias("at"), number(df, amount).alias("amount")).dropna(subset=["customer", "at"])
    last = rows.agg(F.max("at").alias("ref"))
    by = rows.groupBy("customer").agg(F.max("at").alias("at"), *([F.coalesce(F.sum("amount"), F.lit(0.0)).alias("value")] if amount else [F.lit(None).cast("double").alias("value")]))
    days = F.floor((F.col("ref").cast("double") - F.col("at").cast("double")) / 86400).cast("int")
    by = by.join(F.broadcast(last)).withColumn("inactive_days", days)  # last: one row
    status = F.when(F.col("inactive_days") >= churn_days, "churned").when(F.col("inactive_days") >= at_risk_days, "at_risk").otherwise("active")
    return by.select("customer", F.col("at").cast("date").alias("last_date"), "inactive_days", "value", status.alias("status"))


def churn_summary(customers: DataFrame) -> DataFrame:
    """One row: customers by status, churn rate, value of the customers that are not active."""
    out = customers.agg(F.count("*").alias("customers"), *(F.count_if(F.col("status") == s).alias(f"{s}_customers") for s in ("active", "at_risk", "churned")), F.sum(F.when(F.col("status") != "active", F.col("value"))).alias("value_at_risk"))
    return out.withColumn("churn_rate", F.coalesce(share(F.col("churned_customers"), F.col("customers")), F.lit(0.0)))


def churn_trend(df: DataFrame, customer: str, date: str, months: int = 24) -> DataFrame:
    """month, active_customers of the latest observed months."""
    rows = _customers(df, customer, date, None).select("customer", bucket(F.col("at"), "month").alias("month"))
    return rows.groupBy("month").agg(F.count_distinct("customer").alias("active_customers")).orderBy(F.desc("month")).limit(months)


def most_inactive(customers: DataFrame, limit: int = 20) -> DataFrame:
    """Customers that are not active, the longest inactive first."""
    return customers.where(F.col("status") != "active").orderBy(F.desc("inactive_days"), "customer").limit(limit)
