"""The generic query, page previews and KPIs."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import change
from ..plans.compile import apply_filters, kind_of, label_of, predicate, quoted
from ..plans.grouping import aggregates, check, grouped
from ..plans.requests import Aggregate, Formula, Kpi, Metric, Query, RequestError, need
from .timeseries import growth

KPI_GROUPS, PAGE_ROWS = 25, 200


def run_query(df: DataFrame, q: Query) -> DataFrame:
    """Filter, then group or project, then sort (nulls last in both directions) and limit.

    Groups keep the null key and come out sorted by key unless sort_by says otherwise. Sort and limit plan as one top-k, so no
    task holds more than `limit` rows of a sorted result.
    """
    rows = apply_filters(df, q.filters)
    for c in (*q.group_by, *q.columns):
        kind_of(df, c)
    if q.group_by or q.aggregations:
        made = {a.name: a for a in q.aggregations or (Aggregate("count"),)}
        out = aggregates(rows, {c: quoted(c) for c in q.group_by}, made)
    else:
        out = rows.select(*(quoted(c) for c in q.columns)) if q.columns else rows
    if q.sort_by:
        need(q.sort_by in out.columns, f"cannot sort by {q.sort_by!r}")
        key = quoted(q.sort_by)
        # ties are broken by the groups, or else by all columns, so the same rows come out at every run
        ties = [quoted(c).asc_nulls_last() for c in q.group_by or _sortable(out) if c != q.sort_by]
        out = out.orderBy(key.desc_nulls_last() if q.sort_desc else key.asc_nulls_last(), *ties)
    elif q.group_by:
        out = out.orderBy(*(quoted(c).asc_nulls_last() for c in q.group_by))
    return out.limit(q.limit)


def _sortable(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if not kind.startswith(("map", "variant")) and "map<" not in kind]


def total_matched(df: DataFrame, q: Query) -> int:
    """How many rows pass a query's filters."""
    return apply_filters(df, q.filters).count()


def preview(df: DataFrame, page: int, size: int, order: str) -> DataFrame:
    """Page number `page` (from 1) in the order of an ordinal column."""
    need(page >= 1 and 1 <= size <= PAGE_ROWS, f"pages start at 1 and hold up to {PAGE_ROWS} rows")
    kind_of(df, order)
    return df.orderBy(quoted(order).asc_nulls_last()).offset((page - 1) * size).limit(size)


def metrics(df: DataFrame, wanted: dict[str, Metric | Formula]) -> DataFrame:
    """metric, value: any number of ungrouped metrics and formulas, all in one pass over df."""
    one = grouped(df, {}, {f"m{i}": m for i, m in enumerate(wanted.values())})
    pairs = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, name in enumerate(wanted)))
    return one.select(F.explode(pairs).alias("x")).select("x.metric", "x.value")


def evaluate_kpis(df: DataFrame, wanted: list[Kpi]) -> DataFrame:
    """kpi, value, available, reason for up to 25 ungrouped KPIs, all in one pass.

    A KPI's filters hold for each of its metrics, besides the metric's own. A KPI that names an unknown column, has no metric or breaks a
    limit is not available, for the reason given; the others are worked out all the same. So is one whose value is null.
    """
    need(1 <= len(wanted) <= KPI_GROUPS, f"1 to {KPI_GROUPS} KPIs")
    cells: dict[str, Formula] = {}
    filters, reasons = {}, []
    for i, k in enumerate(wanted):
        try:
            need(k.formula or k.metric, "no metric")
            filters[f"k{i}"] = predicate(df, k.filters)
            check(df, k.formula or k.metric)
            cells[f"k{i}"] = k.formula or k.metric
            reasons.append(None)
        except RequestError as e:
            reasons.append(str(e))
    one = grouped(df, {}, cells or {"none": Metric("count")}, filters)
    value = lambda i: F.col(f"k{i}") if f"k{i}" in cells else F.lit(None).cast("double")
    pairs = F.array(*(F.struct(F.lit(k.name).alias("kpi"), value(i).alias("value"), F.lit(why).cast("string").alias("why")) for i, (k, why) in enumerate(zip(wanted, reasons, strict=True))))
    out = one.select(F.explode(pairs).alias("x")).select("x.*")
    reason = F.coalesce("why", F.when(F.col("value").isNull(), "no value"))
    return out.select("kpi", "value", reason.isNull().alias("available"), reason.alias("reason"))


def kpis(df: DataFrame, wanted: list[Kpi]) -> DataFrame:
    """kpi, value of evaluate_kpis(): null where a KPI is not available."""
    return evaluate_kpis(df, wanted).select("kpi", "value")


def kpi_groups(df: DataFrame, k: Kpi) -> DataFrame:
    """label, value: a KPI by its group_by column, the 25 largest, ties by label."""
    need(k.group_by, "this KPI has no group_by")
    rows = apply_filters(df, k.filters)
    kind_of(df, k.group_by)
    out = grouped(rows, {"key": quoted(k.group_by)}, {"value": k.formula or k.metric}).where("value IS NOT NULL")
    return out.select(label_of(F.col("key")).alias("label"), "value").orderBy(F.desc("value"), "label").limit(KPI_GROUPS)


def kpi_comparison(df: DataFrame, k: Kpi, date_column: str, period: str) -> DataFrame:
    """One row: the last period against the one before; the change is null where the base is null or zero."""
    rows = apply_filters(df, k.filters)
    points = growth(rows, date_column, period, k.metric or Metric("count"))
    last = points.orderBy(F.desc("bucket")).limit(1)
    return last.select("label", F.col("value").alias("current_value"), F.col("previous_value"), (F.col("value") - F.col("previous_value")).alias("change_value"), change(F.col("value"), F.col("previous_value")).alias("change_pct"))


@dataclass(frozen=True)
class CatalogEntry:
    name: str
    kpi: Kpi | None
    available: bool = True
    reason: str | None = None


def kpi_catalog(columns: list[dict[str, Any]]) -> list[CatalogEntry]:
    """KPIs that a frame supports, from its column roles: rows, sums and averages, distinct counts and ratios."""
    measures = [c["column"] for c in columns if c["measure"]]
    ids = [c["column"] for c in columns if c["identifier"]]
    out = [CatalogEntry("Row count", Kpi("Row count", Metric("count")))]
    for m in measures[:6]:
        out += [CatalogEntry(f"{word} {m}", Kpi(f"{word} {m}", Metric(f, m))) for word, f in (("Total", "sum"), ("Average", "average"))]
    out += [CatalogEntry(f"Unique {i}", Kpi(f"Unique {i}", Metric("distinct_count", i))) for i in ids[:4]]
    if measures and ids:
        from ..plans.requests import Binary

        ratio = Binary("/", Metric("sum", measures[0]), Metric("distinct_count", ids[0]))
        out.append(CatalogEntry(f"{measures[0]} per {ids[0]}", Kpi(f"{measures[0]} per {ids[0]}", formula=ratio)))
    if not measures:
        out.append(CatalogEntry("Totals", None, False, "no numeric measure"))
    if not ids:
        out.append(CatalogEntry("Unique counts", None, False, "no identifier column"))
    if not any(c["temporal"] for c in columns):
        out.append(CatalogEntry("Growth", None, False, "no date column"))
    return out


__all__ = ["run_query", "total_matched", "preview", "metrics", "evaluate_kpis", "kpis", "kpi_groups", "kpi_comparison", "kpi_catalog"]
