"""Dashboards and reports: widgets and sections over one frame; a failing one does not stop the others."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..plans.compile import apply_filters, merge_filters
from ..plans.requests import Aggregate, Binary, FilterSet, Kpi, Metric, Plan, Query, RequestError, need
from ..sources.storage import write_xlsx
from . import charts, customers, distribution, forecast, insights, profile, query, questions, ranking, segmentation, timeseries

TABLE_ROWS, CORRELATION = 25, 0.3
WIDGETS = ("kpi", "chart", "table", "insight", "recommendation", "text", "question", "advanced")
TEMPLATES = {
    "executive": ("summary", "overview", "kpis", "trends", "health", "recommendations"),
    "sales": ("summary", "kpis", "trends", "abc", "pareto", "forecast", "recommendations"),
    "customers": ("summary", "rfm", "cohorts", "churn", "segmentation", "recommendations"),
    "data_quality": ("overview", "quality", "statistics", "correlation", "outliers"),
}


def rows_of(df: DataFrame, limit: int = TABLE_ROWS) -> list[dict[str, Any]]:
    """The first rows, as plain values: NaN and infinities are null, dates ISO text."""

    def plain(v: Any) -> Any:
        if isinstance(v, float):
            return v if v == v and abs(v) != float("inf") else None
        return v.isoformat() if hasattr(v, "isoformat") else v

    return [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.limit(limit).collect()]


@dataclass(frozen=True)
class Widget:
    kind: str
    title: str
    config: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        need(self.kind in WIDGETS, f"unknown widget {self.kind!r}")


def _advanced(df: DataFrame, c: dict[str, Any], model: questions.Model) -> Any:
    role = lambda name: model.choose(name, c.get(name))

    made: dict[str, Callable[[], Any]] = {
        "rfm": lambda: rows_of(customers.rfm_segments(customers.rfm(df, role("customer"), role("date"), role("revenue")))),
        "churn": lambda: rows_of(customers.churn_summary(customers.churn_customers(df, role("customer"), role("date"), model.get("revenue")))),
        "cohort": lambda: rows_of(customers.cohort_average(customers.cohort_matrix(df, role("customer"), role("date"), c.get("period", "month"))).orderBy("period_offset")),
        "forecast": lambda: rows_of(forecast.forecast(df, role("date"), c.get("period", "month"), Metric("sum", role("revenue")), c.get("method", "holt"), c.get("horizon", 6))),
        "pareto": lambda: rows_of(ranking.pareto_summary(ranking.pareto(df, role("product"), Metric("sum", role("revenue"))))),
        "segmentation": lambda: rows_of(segmentation.cluster_profiles(df, c.get("columns") or model.of("measure")[:5], c.get("k", 4), c.get("entity"))),
    }
    need(c.get("analysis") in made, f"unknown analysis {c.get('analysis')!r}")
    return made[c["analysis"]]()


class Shared:
    """What the widgets of one refresh have in common: the findings, worked out by the first widget that shows them."""

    def __init__(self) -> None:
        self.found: insights.Report | None = None

    def report(self, df: DataFrame, model: questions.Model) -> insights.Report:
        if self.found is None:
            self.found = insights.detect_all(df, model)
        return self.found


def resolve(df: DataFrame, widget: Widget, model: questions.Model, shared: Shared | None = None) -> Any:
    """A widget's data."""
    shared = shared or Shared()
    c = widget.config
    if widget.kind == "text":
        return c.get("text", "")
    if widget.kind == "kpi":
        over = [Metric(*m) for m in c.get("ratio", ())]
        kpi = Kpi(widget.title, formula=Binary("/", *over)) if over else Kpi(widget.title, Metric(c.get("metric", "count"), c.get("column")), group_by=c.get("group_by"))
        return rows_of(query.kpi_groups(df, kpi) if kpi.group_by else query.kpis(df, [kpi]))
    if widget.kind == "chart":
        if c.get("period"):
            name = {"mean": "average"}.get(c.get("function", "sum"), c.get("function", "sum"))
            return rows_of(timeseries.time_series(df, c["x"], c["period"], Metric(name, c.get("y"))).orderBy("bucket"), 500)
        return rows_of(charts.chart(df, c.get("chart", "bar"), c.get("x"), c.get("y"), c.get("function", "sum"), c.get("group"), limit=c.get("limit", 20), order=c.get("order")), 2000)
    if widget.kind == "table":
        return rows_of(query.run_query(df, Query(columns=tuple(c.get("columns", ())), group_by=tuple(c.get("group_by", ())), aggregations=tuple(Aggregate(*a) for a in c.get("aggregations", ())), sort_by=c.get("sort_by"), sort_desc=c.get("sort_desc", False), limit=c.get("limit", TABLE_ROWS))))
    if widget.kind == "question":
        plan = c.get("plan")
        if isinstance(plan, Plan):
            return rows_of(questions.execute(df, questions.validate(df, model, plan)))
        answer, found = questions.ask(df, c["question"])
        need(found is not None, answer.clarification or "the question has no plan")
        return rows_of(found)
    if widget.kind in ("insight", "recommendation"):
        report = shared.report(df, model)
        return report.recommendations if widget.kind == "recommendation" else [f.__dict__ for f in report.findings if not c.get("severities") or f.severity in c["severities"]][: c.get("limit", 5)]
    return _advanced(df, c, model)


def refresh(df: DataFrame, widgets: list[Widget], filters: FilterSet | None = None, own: FilterSet | None = None) -> list[dict[str, Any]]:
    """Every widget's data over the filtered frame, which is read once and kept (spilling to disk) for the refresh."""
    rows = apply_filters(df, merge_filters(filters, own)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model, shared, out = questions.semantic_model(rows), Shared(), []
        for w in widgets:
            try:
                out.append({"title": w.title, "kind": w.kind, "data": resolve(rows, w, model, shared)})
            except (RequestError, KeyError) as e:
                out.append({"title": w.title, "kind": w.kind, "error": str(e)})
        return out
    finally:
        rows.unpersist()


#: Ready-made dashboards: names of BLOCKS in the order they are shown.
DASHBOARDS = {
    "sales": ("records", "total", "average", "orders", "units", "trend", "by_product", "by_region", "top_products", "pareto", "forecast", "recommendations"),
    "customer": ("records", "customers", "total", "per_customer", "rfm", "churn", "cohorts", "segmentation", "opportunities"),
    "executive": ("records", "total", "orders", "customers", "trend", "by_region", "findings", "risks", "opportunities", "recommendations"),
}
#: What a dashboard is made of: the roles a widget needs, its kind, and its title and configuration by the columns of these roles.
BLOCKS: dict[str, tuple[tuple[str, ...], str, Callable[..., tuple[str, dict[str, Any]]]]] = {
    "records": ((), "kpi", lambda: ("Records", {"metric": "count"})),
    "total": (("revenue",), "kpi", lambda v: (f"Total {v}", {"metric": "sum", "column": v})),
    "average": (("revenue",), "kpi", lambda v: (f"Average {v}", {"metric": "average", "column": v})),
    "orders": (("order",), "kpi", lambda o: ("Orders", {"metric": "distinct_count", "column": o})),
    "customers": (("customer",), "kpi", lambda c: ("Customers", {"metric": "distinct_count", "column": c})),
    "units": (("quantity",), "kpi", lambda q: (f"Total {q}", {"metric": "sum", "column": q})),
    "per_customer": (("revenue", "customer"), "kpi", lambda v, c: (f"{v} for each customer", {"ratio": (("sum", v), ("distinct_count", c))})),
    "trend": (("date", "revenue"), "chart", lambda d, v: (f"{v} by month", {"x": d, "y": v, "period": "month"})),
    "by_product": (("product", "revenue"), "chart", lambda g, v: (f"{v} by {g}", {"chart": "bar", "x": g, "y": v})),
    "by_region": (("region", "revenue"), "chart", lambda g, v: (f"{v} by {g}", {"chart": "bar", "x": g, "y": v})),
    "top_products": (("product", "revenue"), "table", lambda g, v: (f"First ten {g}", {"group_by": [g], "aggregations": [("sum", v)], "sort_by": f"sum_{v}", "sort_desc": True, "limit": 10})),
    "rfm": (("customer", "date", "revenue"), "advanced", lambda *_: ("RFM", {"analysis": "rfm"})),
    "churn": (("customer", "date"), "advanced", lambda *_: ("Churn", {"analysis": "churn"})),
    "cohorts": (("customer", "date"), "advanced", lambda *_: ("Retention", {"analysis": "cohort"})),
    "forecast": (("date", "revenue"), "advanced", lambda *_: ("Forecast", {"analysis": "forecast"})),
    "pareto": (("product", "revenue"), "advanced", lambda *_: ("Pareto", {"analysis": "pareto"})),
    "segmentation": (("customer", "revenue", "quantity"), "advanced", lambda c, v, q: ("Segments", {"analysis": "segmentation", "columns": [v, q], "entity": c})),
    "findings": ((), "insight", lambda: ("Findings", {})),
    "risks": ((), "insight", lambda: ("Risks", {"severities": ("critical", "high"), "limit": 5})),
    "opportunities": ((), "insight", lambda: ("Opportunities", {"severities": ("low", "info"), "limit": 5})),
    "recommendations": ((), "recommendation", lambda: ("Recommendations", {})),
}


def dashboard_template(name: str, model: questions.Model) -> list[Widget]:
    """Widgets of a ready-made dashboard, without those that the frame's roles do not allow."""
    need(name in DASHBOARDS, f"unknown template {name!r}")
    out = []
    for block in DASHBOARDS[name]:
        roles, kind, make = BLOCKS[block]
        columns = [model.get(r) for r in roles]
        if None not in columns:
            out.append(Widget(kind, *make(*columns)))
    return out


def _sections(s: insights.Figures) -> dict[str, Callable[[], Any]]:
    df, model = s.df, s.model
    value, date, customer, product = (model.get(r) for r in ("revenue", "date", "customer", "product"))

    def needs(*roles: str) -> None:
        missing = [r for r in roles if not model.get(r)]
        need(not missing, "needs " + " and ".join(missing))

    def with_roles(roles: tuple[str, ...], make: Callable[[], Any]) -> Callable[[], Any]:
        def section() -> Any:
            needs(*roles)
            return make()

        return section

    measures = model.of("measure")
    return {
        "summary": lambda: [f.title for f in insights.detect(s).findings[:5]],
        "overview": lambda: rows_of(profile.profile_dataset(df)),
        "quality": lambda: s.issues[:TABLE_ROWS],
        "kpis": lambda: rows_of(insights.headline_kpis(df, model)),
        "statistics": lambda: rows_of(profile.numeric_stats(df, measures)),
        "trends": with_roles(("date",), lambda: rows_of(insights.headline_trends(df, model))),
        "segments": lambda: insights.segments_overview(df, model),
        "abc": with_roles(("product", "revenue"), lambda: rows_of(ranking.abc_summary(ranking.abc(df, product, Metric("sum", value))))),
        "pareto": with_roles(("product", "revenue"), lambda: rows_of(ranking.pareto_summary(ranking.pareto(df, product, Metric("sum", value))))),
        "rfm": with_roles(("customer", "date", "revenue"), lambda: rows_of(customers.rfm_segments(customers.rfm(df, customer, date, value)))),
        "cohorts": with_roles(("customer", "date"), lambda: rows_of(customers.cohort_average(customers.cohort_matrix(df, customer, date)).orderBy("period_offset"))),
        "churn": with_roles(("customer", "date"), lambda: rows_of(customers.churn_summary(customers.churn_customers(df, customer, date, value)))),
        "inactive_customers": with_roles(("customer", "date"), lambda: rows_of(customers.most_inactive(customers.churn_customers(df, customer, date, value), TABLE_ROWS))),
        "segmentation": lambda: rows_of(segmentation.cluster_profiles(df, measures[:5])),
        "correlation": lambda: [r for r in rows_of(distribution.correlation_matrix(df, measures[:10]), 100) if abs(r["r"]) >= CORRELATION],
        "outliers": lambda: [{k: v for k, v in a.items() if k not in ("groups", "examples")} for a in s.anomalies],
        "forecast": with_roles(("date", "revenue"), lambda: rows_of(forecast.forecast(df, date, "month", Metric("sum", value)))),
        "health": lambda: insights.health_of(s)["factors"],
        "findings": lambda: [{"title": f.title, "priority": f.priority, "score": f.score} for f in insights.detect(s).findings],
        "risks": lambda: [{"title": f.title, "priority": f.priority} for f in insights.detect(s).findings if f.severity in ("critical", "high")],
        "recommendations": lambda: insights.detect(s).recommendations,
    }


def capabilities(model: questions.Model) -> dict[str, str | None]:
    """Each analysis and, if it is not available, what it lacks."""
    wanted = {"rfm": ("customer", "date", "revenue"), "cohort": ("customer", "date"), "churn": ("customer", "date"), "forecast": ("date", "revenue"), "pareto": ("product", "revenue"), "trends": ("date", "revenue")}
    out = {name: ", ".join(r for r in roles if not model.get(r)) or None for name, roles in wanted.items()}
    for name, least in (("segmentation", 2), ("correlation", 2), ("outliers", 1), ("distribution", 1)):
        out[name] = None if len(model.of("measure")) >= least else f"{least} measures"
    return out


def build_report(df: DataFrame, sections: list[str] | None = None, template: str = "executive") -> dict[str, Any]:
    """Sections by name with their data; those that fail are listed with the reason. Sections share the frame and what is worked out from it."""
    need(sections or template in TEMPLATES, f"unknown template {template!r}")
    wanted = sections or TEMPLATES[template]
    with insights.Figures(df) as s:
        made, out = _sections(s), {"sections": {}, "skipped": {}}
        for name in wanted:
            need(name in made, f"unknown section {name!r}")
        for name in wanted:
            try:
                out["sections"][name] = made[name]()
            except RequestError as e:
                out["skipped"][name] = str(e)
    return out


def render_json(report: dict[str, Any]) -> str:
    return json.dumps(report, default=str, indent=2)


def _tables(report: dict[str, Any]) -> list[tuple[str, list[dict[str, Any]]]]:
    out = []
    for name, data in report["sections"].items():
        rows = data if isinstance(data, list) else [{"item": k, "value": json.dumps(v, default=str)} for k, v in data.items()]
        out.append((name, [r if isinstance(r, dict) else {"item": r} for r in rows]))
    return out


def render_csv(report: dict[str, Any]) -> str:
    """Sections one below the other. Cells that a spreadsheet would run as a formula are quoted."""
    out = io.StringIO()
    w = csv.writer(out)
    safe = lambda v: f"'{v}" if isinstance(v, str) and v[:1] in ("=", "+", "-", "@") else v
    for name, rows in _tables(report):
        w.writerow([name])
        keys = list(dict.fromkeys(k for r in rows for k in r))
        w.writerow(keys)
        w.writerows([safe(r.get(k)) for k in keys] for r in rows)
        w.writerow([])
    return out.getvalue()


def render_xlsx(report: dict[str, Any]) -> bytes:
    """A workbook with a sheet for each section."""
    sheets: dict[str, list[list[Any]]] = {}
    plain = lambda v: v if v is None or isinstance(v, str | int | float) else json.dumps(v, default=str)
    for name, rows in _tables(report):
        keys = list(dict.fromkeys(k for r in rows for k in r))
        sheets[name] = [keys, *([plain(r.get(k)) for k in keys] for r in rows)]
    return write_xlsx(sheets or {"report": []})


def render_html(report: dict[str, Any], title: str = "Report") -> str:
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, rows in _tables(report):
        keys = list(dict.fromkeys(k for r in rows for k in r))
        head = "".join(f"<th>{html.escape(str(k))}</th>" for k in keys)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(k, '')))}</td>" for k in keys) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)
