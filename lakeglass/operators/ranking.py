"""Grouped analytics: segments, rankings, contribution, ABC, Pareto, entities.

Each groups first; windows and sorts then see one row a group. Ties are broken by label, so results are the same at every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import share
from ..plans.compile import apply_filters, fresh, kind_of, label_of, number, quoted
from ..plans.grouping import grouped
from ..plans.requests import FilterSet, Metric, need
from ..sources.storage import written

MAX_GROUPS = 500


def grouped_metric(df: DataFrame, dimension: str, m: Metric, filters: FilterSet | None = None) -> DataFrame:
    """label, value for every group, the null key among them; groups without a value are left out."""
    kind_of(df, dimension)
    out = grouped(apply_filters(df, filters), {"key": quoted(dimension)}, {"value": m}).where("value IS NOT NULL")
    return out.select(label_of(F.col("key")).alias("label"), "value")


def _with_total(groups: DataFrame) -> DataFrame:
    """Each group with the total over all groups and their number, which are one row. Both sides read the same exchange of groups."""
    whole = groups.agg(F.sum("value").alias("total"), F.count("*").alias("group_count"))
    return groups.join(F.broadcast(whole))  # whole: one row


def segment(df: DataFrame, dimension: str, m: Metric, filters: FilterSet | None = None, descending: bool = True, limit: int = 20) -> DataFrame:
    """label, value, share_pct, group_count: the first `limit` groups; shares are of all groups' total."""
    need(1 <= limit <= MAX_GROUPS, f"limit must be 1 to {MAX_GROUPS}")
    out = _with_total(grouped_metric(df, dimension, m, filters))
    order = F.desc("value") if descending else F.asc("value")
    return out.select("label", "value", share(F.col("value"), F.col("total")).alias("share_pct"), "group_count").orderBy(order, "label").limit(limit)


def ranking(df: DataFrame, dimension: str, m: Metric, filters: FilterSet | None = None, top: bool = True, limit: int = 20) -> DataFrame:
    """rank and the columns of segment()."""
    out = segment(df, dimension, m, filters, top, limit)
    order = F.desc("value") if top else F.asc("value")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(order, "label")))


def contribution(df: DataFrame, dimension: str, m: Metric, filters: FilterSet | None = None, limit: int = MAX_GROUPS) -> DataFrame:
    """label, value, share_pct, cumulative_pct, group_count, from the largest group down. Sums run over the `limit` rows that are asked for."""
    need(1 <= limit <= MAX_GROUPS, f"limit must be 1 to {MAX_GROUPS}")
    return contribution_of(grouped_metric(df, dimension, m, filters), limit)


def contribution_of(groups: DataFrame, limit: int = MAX_GROUPS) -> DataFrame:
    """contribution() of groups that are there already (label, value)."""
    top = _with_total(groups).orderBy(F.desc("value"), "label").limit(limit)
    order = Window.orderBy(F.desc("value"), "label")
    out = top.withColumn("running", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(order))
    return out.select("rank", "label", "value", share(F.col("value"), F.col("total")).alias("share_pct"), share(F.col("running"), F.col("total")).alias("cumulative_pct"), "group_count")


def running(rows: DataFrame, order: list[Column], value: str) -> DataFrame:
    """rows with rank (from 1) and running (the sum of value up to the row) in an order, worked out in parallel.

    Rows are range-partitioned and added up within each range; what comes before a range is one row each. A window over all rows
    would sort them in one task.
    """
    part = fresh(rows, "part")
    held = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = held.groupBy(part).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    ends = ends.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s_before"))
    own = Window.partitionBy(part).orderBy(*order)
    out = held.withColumn("rank", F.row_number().over(own)).withColumn("running", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # ends: one row a partition
    return out.join(F.broadcast(ends), part).withColumns({"rank": F.col("rank") + F.col("n_before"), "running": F.col("running") + F.col("s_before")}).drop(part, "n_before", "s_before")


def abc(df: DataFrame, dimension: str, m: Metric, filters: FilterSet | None = None, a: float = 80.0, b: float = 95.0) -> DataFrame:
    """rank, label, value, share_pct, cumulative_pct, class of each group with a positive value.

    The class goes by the cumulative share with the group itself, so a first group over `a` is no A.
    """
    need(0 < a < b <= 100, "the limits must rise")
    positive = grouped_metric(df, dimension, m, filters).where("value > 0")
    out = _with_total(running(positive, [F.desc("value"), F.col("label")], "value"))
    out = out.withColumn("cumulative", share(F.col("running"), F.col("total")))
    # sums in another order may end a hair above the limit they meet
    eps = 1e-9
    kind = F.when(F.col("cumulative") <= a + eps, "A").when(F.col("cumulative") <= b + eps, "B").otherwise("C")
    return out.select(F.col("rank").cast("int").alias("rank"), "label", "value", F.round(share(F.col("value"), F.col("total")), 4).alias("share_pct"), F.round("cumulative", 4).alias("cumulative_pct"), kind.alias("class"))


def abc_summary(rows: DataFrame) -> DataFrame:
    """class, groups, value, value_pct for A, B and C, of abc()'s rows; a class without groups counts 0."""
    spark = rows.sparkSession
    classes = spark.range(3).select(F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") + 1).cast("int")).alias("class"))
    found = rows.groupBy("class").agg(F.count("*").alias("groups"), F.sum("value").alias("value"))
    out = classes.join(found, "class", "left").select("class", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return out.withColumn("value_pct", F.coalesce(share(F.col("value"), F.sum("value").over(Window.partitionBy())), F.lit(0.0)))


def pareto(df: DataFrame, dimension: str, m: Metric, filters: FilterSet | None = None, threshold: float = 80.0, limit: int = MAX_GROUPS) -> DataFrame:
    """contribution() with vital_few: true up to and including the group that reaches the threshold."""
    need(0 < threshold <= 100, "the threshold is a per cent")
    out = contribution(df, dimension, m, filters, limit)
    before = F.coalesce(F.lag("cumulative_pct").over(Window.orderBy("rank")), F.lit(0.0))
    return out.withColumn("vital_few", before < threshold)


def pareto_summary(rows: DataFrame) -> DataFrame:
    """One row: vital groups, all groups, vital share of groups and of value."""
    out = rows.agg(F.count_if("vital_few").alias("vital_groups"), F.max("group_count").alias("group_count"), F.max(F.when(F.col("vital_few"), F.col("cumulative_pct"))).alias("vital_value_pct"))
    return out.withColumn("vital_groups_pct", share(F.col("vital_groups"), F.col("group_count")))


def _entities(df: DataFrame, entity: str, value: str | None, transaction: str | None, filters: FilterSet | None) -> DataFrame:
    kind_of(df, entity)
    rows = apply_filters(df, filters).where(quoted(entity).isNotNull())
    made = [F.count("*").alias("records")]
    if transaction:
        kind_of(df, transaction)
        made.append(F.count_distinct(quoted(transaction)).alias("transactions"))
    if value:
        made.append(F.coalesce(F.sum(number(df, value)), F.lit(0.0)).alias("total_value"))
    return rows.groupBy(quoted(entity).cast("string").alias("entity")).agg(*made)


def entity_summary(df: DataFrame, entity: str, value: str | None = None, transaction: str | None = None, filters: FilterSet | None = None) -> DataFrame:
    """One row: entities, repeat and one-time ones, records and value for each."""
    e = _entities(df, entity, value, transaction, filters)
    made = [F.count("*").alias("entities"), F.count_if(F.col("records") > 1).alias("repeat_entities"), F.count_if(F.col("records") == 1).alias("one_time_entities"), F.avg("records").alias("records_per_entity")]
    if transaction:
        made.append(F.avg("transactions").alias("transactions_per_entity"))
    if value:
        made += [F.sum("total_value").alias("total_value"), F.avg("total_value").alias("value_per_entity"), F.try_divide(F.sum("total_value"), F.sum("records")).alias("value_per_record")]
    out = e.agg(*made)
    return out.withColumn("repeat_pct", share(F.col("repeat_entities"), F.col("entities")))


def entity_top(df: DataFrame, entity: str, value: str | None = None, transaction: str | None = None, filters: FilterSet | None = None, limit: int = 20) -> DataFrame:
    """The entities with the largest total (without a value: the most records)."""
    e = _entities(df, entity, value, transaction, filters)
    if value:
        e = e.withColumn("average_value", F.try_divide(F.col("total_value"), F.col("records").cast("double")))
    return e.orderBy(F.desc("total_value" if value else "records"), "entity").limit(limit)
