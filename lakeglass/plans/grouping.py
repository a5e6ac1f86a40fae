"""Grouped metrics and formulas. Sums, counts and extremes are one aggregate; medians are exact quantiles by distributed selection, joined to it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from .compile import aggregate, held, is_median, metric, number, quoted
from .requests import MAX_FORMULA_DEPTH, Aggregate, Binary, Constant, Formula, Metric, need


def group_by(rows: DataFrame, keys: Mapping[str, Column], plain: Mapping[str, Column], medians: Mapping[str, Column]) -> DataFrame:
    """The keys, the aggregates of `plain` and the medians of the columns in `medians` for each group; one row without keys.

    Nothing but the counts of values leaves a task for a median. Null keys are a group.
    """
    at = [c.alias(name) for name, c in keys.items()]
    made = [c.alias(name) for name, c in plain.items()]
    if not medians:
        return rows.groupBy(*at).agg(*made) if at else rows.agg(*made)
    base = rows.groupBy(*at).agg(*made, F.count("*").alias("__rows")) if at else rows.agg(*made, F.count("*").alias("__rows"))
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), c.cast("double").alias("v")) for i, c in enumerate(medians.values()))))
    long = rows.select(*at, cells.alias("__x")).select(*(quoted(k) for k in keys), "__x.*")
    q = quantiles(long, [*keys, "which"], "v", [0.5], few=not keys)
    picked = [F.max(F.when(F.col("which") == i, F.col("q")[0])).alias(name) for i, name in enumerate(medians)]
    if not keys:
        return base.join(F.broadcast(q.agg(*picked))).drop("__rows")  # both one row
    wide = q.groupBy(*(quoted(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(*picked)
    same = [quoted(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return base.join(wide, same, "left").drop("__rows", *(f"__k{i}" for i in range(len(keys))))


def check(df: DataFrame, f: Formula, depth: int = 0) -> None:
    """Refuses a formula that names unknown columns or breaks a limit."""
    need(depth <= MAX_FORMULA_DEPTH, f"a formula may nest {MAX_FORMULA_DEPTH} deep")
    if isinstance(f, Binary):
        check(df, f.left, depth + 1)
        check(df, f.right, depth + 1)
    elif isinstance(f, Metric) and not is_median(df, f):
        metric(df, f)
    elif isinstance(f, Metric):
        held(df, f, number(df, f.column))


def grouped(rows: DataFrame, keys: Mapping[str, Column], wanted: Mapping[str, Formula], also: Mapping[str, Column | None] | None = None) -> DataFrame:
    """The keys and each wanted metric or formula by group. A formula with a null operand or a zero divisor is null. also: filters of single ones."""
    plain: dict[str, Column] = {}
    medians: dict[str, Column] = {}

    def cell(f: Formula, extra: Column | None, depth: int = 0) -> Column:
        need(depth <= MAX_FORMULA_DEPTH, f"a formula may nest {MAX_FORMULA_DEPTH} deep")
        if isinstance(f, Constant):
            return F.lit(float(f.value))
        if isinstance(f, Metric):
            name = f"__m{len(plain) + len(medians)}"
            if is_median(rows, f):
                medians[name] = held(rows, f, number(rows, f.column), extra)
            else:
                plain[name] = metric(rows, f, extra)
            return F.col(name)
        assert isinstance(f, Binary)
        a, b = cell(f.left, extra, depth + 1), cell(f.right, extra, depth + 1)
        return F.try_divide(a, b) if f.op == "/" else {"+": a + b, "-": a - b, "*": a * b}[f.op]

    made = [cell(f, (also or {}).get(name)).alias(name) for name, f in wanted.items()]
    return group_by(rows, keys, plain, medians).select(*(quoted(k) for k in keys), *made)


def aggregates(rows: DataFrame, keys: Mapping[str, Column], wanted: Mapping[str, Aggregate]) -> DataFrame:
    """The same for the aggregations of the generic query."""
    plain = {name: aggregate(rows, a) for name, a in wanted.items() if a.function != "median"}
    medians = {name: aggregate(rows, a) for name, a in wanted.items() if a.function == "median"}
    return group_by(rows, keys, plain, medians).select(*(quoted(k) for k in keys), *(quoted(n) for n in wanted))
