"""Insight runs: what an analysis found at a point in time, kept and told from what is current; and the analyst's report on one frame.

A run is one small JSON file, committed once and never changed. It says which version of a dataset it looked at and by which rules. It is stale when the
dataset has moved on, or the rules, or the filters it was asked for are others; stale runs are shown as such, not hidden.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame

from ..plans.compile import apply_filters
from ..plans.requests import FilterSet, need
from ..sources.storage import Versions, commit_once, read_lines
from . import insights, questions
from .query import metrics

#: Raised when a change of the rules makes earlier runs out of date.
ANALYSIS_VERSION = 2


def fingerprint(filters: FilterSet | None, roles: dict[str, str]) -> str:
    """What a run's result depends on besides the data: rules, filters and the columns' roles."""
    asked = [] if filters is None else [filters.combine, *(asdict(c) for c in filters.conditions)]
    return hashlib.sha256(json.dumps([ANALYSIS_VERSION, asked, sorted(roles.items())], default=str, sort_keys=True).encode()).hexdigest()


def analyst_report(s: insights.Figures) -> dict[str, Any]:
    """Overview, headline figures, trends, anomalies with examples, segments, findings and recommendations, from one frame that is read together."""
    model = s.model
    roles = [{"column": c["column"], "type": c["type"], "use": next((u for u in ("temporal", "identifier", "categorical", "measure") if c[u]), "other")} for c in model.columns]
    found = insights.detect(s)
    trends = [r.asDict() for r in s.trends(insights.trend_metrics(model))] if model.get("date") and s.measures else []
    return {
        "overview": {"rows": s.base["rows"], "columns": roles, "roles": model.roles, "first": s.base.get("first"), "last": s.base.get("last")},
        "headlines": {r["metric"]: r["value"] for r in metrics(s.df, insights.headline_metrics(model)).collect()},
        "trends": trends,
        "anomalies": s.anomalies,
        "segments": insights.segments_overview(s.df, model),
        "findings": [asdict(f) for f in found.findings],
        "skipped": found.skipped,
        "recommendations": found.recommendations,
        "questions": questions.suggestions(model),
    }


class InsightRuns:
    """The runs on one dataset's versions, in <root>/insights."""

    def __init__(self, versions: Versions):
        self.versions, self.spark, self.folder = versions, versions.spark, f"{versions.root}/insights"

    def _frame(self, version: int, filters: FilterSet | None) -> DataFrame:
        return apply_filters(self.versions.read(version), filters)

    def generate(self, version: int | None = None, filters: FilterSet | None = None, keep: bool = True) -> dict[str, Any]:
        """Analyse a version (the latest if none is named) and record the run, unless asked not to."""
        number = self.versions.get(version)["version"]
        rows = self._frame(number, filters)
        need(not rows.isEmpty(), "no rows pass the filters")
        with insights.Figures(rows) as s:
            result = analyst_report(s)
            mark = fingerprint(filters, s.model.roles)
        run = {"id": uuid.uuid4().hex, "at": datetime.now(UTC).isoformat(), "version": number, "analysis": ANALYSIS_VERSION, "fingerprint": mark, "filters": None if filters is None else asdict(filters), "result": json.loads(json.dumps(result, default=str))}
        if keep:
            need(commit_once(self.spark, f"{self.folder}/{run['id']}.json", json.dumps(run) + "\n"), "the run is there already")
        return run

    def list(self) -> list[dict[str, Any]]:
        """All runs, the newest first."""
        return sorted(read_lines(self.spark, self.folder), key=lambda r: (r["at"], r["id"]), reverse=True)

    def get(self, run: str) -> dict[str, Any]:
        found = [r for r in self.list() if r["id"] == run]
        need(found, f"there is no run {run!r}")
        return found[0]

    def stale(self, run: dict[str, Any], viewing: int | None = None) -> bool:
        """Whether a run no longer says what is so: other rules, or another version than the one viewed (the latest if none is)."""
        return run["analysis"] != ANALYSIS_VERSION or run["version"] != self.versions.get(viewing)["version"]

    def latest(self, viewing: int | None = None) -> dict[str, Any] | None:
        """The newest run, with stale; None if there is none."""
        known = self.list()
        return known[0] | {"stale": self.stale(known[0], viewing)} if known else None

    def refresh(self, run: str) -> dict[str, Any]:
        """The same analysis of the same version again, as a run of its own."""
        old = self.get(run)
        return self.generate(old["version"], _filters(old["filters"]))


def _filters(held: dict[str, Any] | None) -> FilterSet | None:
    from ..plans.requests import Condition

    return None if held is None else FilterSet(tuple(Condition(**c) for c in held["conditions"]), held["combine"])
