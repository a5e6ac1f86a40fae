"""The structured requests that operators are called with. Each checks its own limits; columns are checked against a frame."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# The names and limits of the request surface.
OPERATORS = ("equals", "not_equals", "contains", "greater_than", "greater_or_equal", "less_than", "less_or_equal", "between", "is_null", "is_not_null")
AGGREGATIONS = ("count", "sum", "mean", "median", "min", "max")
METRICS = ("count", "distinct_count", "sum", "average", "median", "min", "max", "range", "std_dev")
NUMERIC_METRICS = ("sum", "average", "median", "range", "std_dev")
MAX_CONDITIONS, MAX_GROUPS, MAX_AGGREGATIONS, MAX_COLUMNS, MAX_ROWS = 20, 3, 10, 50, 5000
MAX_FORMULA_DEPTH = 8


class RequestError(ValueError):
    """A request that names an unknown column, breaks a limit or asks for something its column cannot give."""


def need(condition: object, message: str) -> None:
    if not condition:
        raise RequestError(message)


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: Any = None
    upper: Any = None

    def __post_init__(self) -> None:
        need(self.op in OPERATORS, f"unknown operator {self.op!r}")
        if self.op == "between":
            need(self.value is not None and self.upper is not None, "between needs both bounds")
        elif self.op not in ("is_null", "is_not_null"):
            need(self.value is not None, f"{self.op} needs a value")


@dataclass(frozen=True)
class FilterSet:
    conditions: tuple[Condition, ...] = ()
    combine: str = "and"

    def __post_init__(self) -> None:
        need(self.combine in ("and", "or"), "filters are combined by 'and' or 'or'")
        need(len(self.conditions) <= MAX_CONDITIONS, f"at most {MAX_CONDITIONS} conditions")


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None = None
    alias: str | None = None

    def __post_init__(self) -> None:
        need(self.function in AGGREGATIONS, f"unknown aggregation {self.function!r}")
        need(self.column or self.function == "count", f"{self.function} needs a column")

    @property
    def name(self) -> str:
        return self.alias or f"{self.function}_{self.column or 'rows'}"


@dataclass(frozen=True)
class Query:
    filters: FilterSet = FilterSet()
    group_by: tuple[str, ...] = ()
    aggregations: tuple[Aggregate, ...] = ()
    columns: tuple[str, ...] = ()
    sort_by: str | None = None
    sort_desc: bool = False
    limit: int = 100

    def __post_init__(self) -> None:
        need(len(self.group_by) <= MAX_GROUPS, f"at most {MAX_GROUPS} group columns")
        need(len(self.aggregations) <= MAX_AGGREGATIONS, f"at most {MAX_AGGREGATIONS} aggregations")
        need(len(self.columns) <= MAX_COLUMNS, f"at most {MAX_COLUMNS} columns")
        need(1 <= self.limit <= MAX_ROWS, f"limit must be 1 to {MAX_ROWS}")


@dataclass(frozen=True)
class Metric:
    name: str
    column: str | None = None
    filters: FilterSet | None = None

    def __post_init__(self) -> None:
        need(self.name in METRICS, f"unknown metric {self.name!r}")
        need(self.column or self.name == "count", f"{self.name} needs a column")


@dataclass(frozen=True)
class Constant:
    value: float


@dataclass(frozen=True)
class Binary:
    op: str
    left: Metric | Constant | Binary
    right: Metric | Constant | Binary

    def __post_init__(self) -> None:
        need(self.op in ("+", "-", "*", "/"), f"unknown operation {self.op!r}")


Formula = Metric | Constant | Binary


@dataclass(frozen=True)
class Kpi:
    name: str
    metric: Metric | None = None
    formula: Formula | None = None
    filters: FilterSet = FilterSet()
    group_by: str | None = None

    def __post_init__(self) -> None:
        need(self.metric or self.formula, "a KPI needs a metric or a formula")


@dataclass(frozen=True)
class Plan:
    """What a question asks for: validated before any job starts."""

    intent: str
    measures: tuple[Metric, ...] = ()
    dimensions: tuple[str, ...] = ()
    date_column: str | None = None
    period: str | None = None
    filters: FilterSet = FilterSet()
    descending: bool = True
    limit: int = 50


@dataclass
class Answer:
    plan: Plan | None
    clarification: str | None = None
    candidates: list[str] = field(default_factory=list)
    source: str = "rules"
