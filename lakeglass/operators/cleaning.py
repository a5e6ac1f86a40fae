"""Cleaning operations and the pipeline that replays them.

Row order is semantic for fills and for which duplicate stays; it is given by an ordinal column, never implied.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.dates import as_timestamp
from ..plans.compile import fresh, is_number, kind_of, number, quoted
from ..plans.grouping import group_by
from ..plans.requests import RequestError, need
from ..sources.storage import Versions, written
from .distribution import bounds

# Texts that mean true and false, target types, the most operations of a pipeline.
TRUE, FALSE = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")
TYPES = ("string", "integer", "float", "boolean", "date", "datetime")
STRATEGIES = ("mean", "median", "mode", "forward_fill", "backward_fill", "custom")
MAX_OPERATIONS = 100
#: Operations that change cells of their column.
CELLS = ("fill_missing", "convert_type", "handle_outliers")
NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


@dataclass(frozen=True)
class Operation:
    """One step: its name and parameters, as JSON would hold them."""

    name: str
    column: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


def fill_missing(df: DataFrame, column: str, strategy: str, value: Any = None, order: str | None = None) -> DataFrame:
    """Nulls of a column by its mean, median, mode (the smallest of equals), a given value, or the nearest row in an order.

    A statistic is one row, joined to each. Forward and backward fill carry values over ranges of the order in parallel.
    """
    need(strategy in STRATEGIES, f"unknown strategy {strategy!r}")
    kind, c = kind_of(df, column), quoted(column)
    if strategy == "custom":
        need(value is not None, "a custom fill needs a value")
        return df.withColumn(column, F.coalesce(c, F.lit(value).try_cast(kind)))
    if strategy in ("forward_fill", "backward_fill"):
        need(order, "filling from neighbours needs an ordinal column")
        return carry(df, column, order, strategy == "forward_fill")
    need(strategy == "mode" or is_number(kind), f"{strategy} needs a number, and {column!r} is {kind}")
    fill = fresh(df, "fill")
    if strategy == "mode":
        # ties go to the smallest value; counts are pre-aggregated
        counts = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"))
        stat = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(fill))
    else:
        stat = df.agg(F.avg(number(df, column)).alias(fill)) if strategy == "mean" else group_by(df, {}, {}, {fill: number(df, column)})
    filled = F.coalesce(c, F.col(fill)) if strategy == "mode" else F.coalesce(c.cast("double"), F.col(fill))
    return df.join(F.broadcast(stat)).withColumn(column, filled).drop(fill)  # stat: one row


def carry(df: DataFrame, column: str, order: str, forward: bool = True) -> DataFrame:
    """The last value before (or the next after) each null in the order of a column; rows without an ordinal come last.

    Rows are range-partitioned by the order; each range fills itself, and what it starts with comes from the ranges before
    it, whose last values are one row each. A window over the whole frame would sort everything in one task. Filling backward is filling
    forward in the order turned round: a frame up to the end of the range would be read anew for every row.
    """
    kind_of(df, order)
    part, end, edge = (fresh(df, x) for x in ("part", "end", "edge"))
    key, c = quoted(order), quoted(column)
    held = written(df.repartitionByRange(key.asc_nulls_last()).withColumn(part, F.spark_partition_id()))
    own = Window.partitionBy(part).orderBy(key.asc_nulls_last() if forward else key.desc_nulls_first())
    across = Window.orderBy(F.asc(part) if forward else F.desc(part))
    pick = F.max_by if forward else F.min_by
    ends = held.where(c.isNotNull()).groupBy(part).agg(pick(c, F.struct(key.isNull(), key)).alias(end))
    parts = held.select(part).distinct().join(ends, part, "left")
    inner = F.last(c, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    outer = F.last(end, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    edges = parts.select(part, outer.alias(edge))  # one row a partition
    return held.join(F.broadcast(edges), part).withColumn(column, F.coalesce(inner, F.col(edge))).select(*(quoted(x) for x in df.columns))


def drop_missing_rows(df: DataFrame, column: str | None = None) -> DataFrame:
    if column:
        kind_of(df, column)
    return df.dropna(subset=[column] if column else None)


def remove_duplicates(df: DataFrame, subset: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The first row (by the ordinal) of those that are equal in a subset of columns, or wholly; nulls are equal.

    The smallest ordinal of each key is found by a pre-aggregated grouping, so a key with very many copies is no hot task.
    """
    if not subset:
        return df.dropDuplicates()
    need(order, "keeping the first of a subset needs an ordinal column")
    for c in (*subset, order):
        kind_of(df, c)
    rest = [c for c in df.columns if c not in subset]
    # null ordinals come last, and ties go by the other columns; the ordinal leads the smallest struct
    sortable = [c for c in rest if "map<" not in dict(df.dtypes)[c]]
    place = F.struct(quoted(order).isNull().alias("late"), quoted(order).alias("at"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(sortable)))
    row = fresh(df, "row")
    first = df.groupBy(*(quoted(c) for c in subset)).agg(F.min_by(F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(rest))), place).alias(row)) if rest else df.select(*(quoted(c) for c in subset)).distinct()
    return first.select(*(quoted(c) if c in subset else F.col(row)[f"c{rest.index(c)}"].alias(c) for c in df.columns))


def converted(df: DataFrame, column: str, to: str) -> Column:
    """A column as another type; what cannot be converted is null. Whole numbers round half to even."""
    need(to in TYPES, f"unknown type {to!r}")
    kind, c = kind_of(df, column), quoted(column)
    if to == "string":
        return c.cast("string")
    text = F.trim(c.cast("string"))
    value = c.cast("double") if is_number(kind) or kind == "boolean" else F.when(text.rlike(NUMBER), text.try_cast("double"))
    if to == "float":
        return value
    if to == "integer":
        return F.bround(value).try_cast("bigint")
    if to == "boolean":
        if kind == "boolean":
            return c
        # 1.0 of a number column counts as 1
        t = F.when(value == 1, "1").when(value == 0, "0").otherwise(F.lower(text)) if is_number(kind) else F.lower(text)
        return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)
    at = as_timestamp(c, kind)
    return F.date_trunc("day", at) if to == "date" else at


def conversion_failures(df: DataFrame, column: str, to: str) -> int:
    return df.agg(F.count_if(quoted(column).isNotNull() & converted(df, column, to).isNull()).alias("n")).first()["n"]


def convert_type(df: DataFrame, column: str, to: str, errors_to_null: bool = False) -> DataFrame:
    """The column converted; refused if values would be lost, unless errors_to_null."""
    if not errors_to_null:
        lost = conversion_failures(df, column, to)
        need(not lost, f"{lost} values of {column!r} cannot become {to}")
    return df.withColumn(column, converted(df, column, to))


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    kind_of(df, column)
    need(new_name.strip() and new_name not in df.columns, f"{new_name!r} is empty or taken")
    return df.withColumnRenamed(column, new_name)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    kind_of(df, column)
    need(len(df.columns) > 1, "the last column cannot go")
    return df.select(*(quoted(c) for c in df.columns if c != column))


def reorder_columns(df: DataFrame, order: list[str]) -> DataFrame:
    for c in order:
        kind_of(df, c)
    need(len(set(order)) == len(order), "a column is named twice")
    return df.select(*(quoted(c) for c in [*order, *(c for c in df.columns if c not in order)]))


def handle_outliers(df: DataFrame, column: str, method: str = "iqr", action: str = "remove", threshold: float = 1.5) -> DataFrame:
    """Rows beyond the bounds removed, or their values moved to the bounds. Nulls stay."""
    need(action in ("remove", "cap"), "action 'remove' or 'cap'")
    need(is_number(kind_of(df, column)), f"{column!r} is no number")
    v = number(df, column)
    lo, hi = fresh(df, "lo"), fresh(df, "hi")
    b = bounds(df, v, method, threshold).select(F.col("lo").alias(lo), F.col("hi").alias(hi))
    both = df.join(F.broadcast(b))  # b: one row
    if action == "remove":
        kept = both.where(F.col(lo).isNull() | v.isNull() | v.between(F.col(lo), F.col(hi)))
    else:
        kept = both.withColumn(column, F.when(F.col(lo).isNull() | v.isNull(), v).otherwise(F.greatest(F.col(lo), F.least(F.col(hi), v))))
    return kept.drop(lo, hi)


def apply_operation(df: DataFrame, op: Operation, order: str | None = None) -> DataFrame:
    o = op.options
    steps: dict[str, Callable[[], DataFrame]] = {
        "fill_missing": lambda: fill_missing(df, op.column, o["strategy"], o.get("value"), order),
        "drop_missing_rows": lambda: drop_missing_rows(df, op.column),
        "remove_duplicates": lambda: remove_duplicates(df, o.get("subset"), order),
        "convert_type": lambda: convert_type(df, op.column, o["to_type"], o.get("errors_to_null", False)),
        "rename_column": lambda: rename_column(df, op.column, o["new_name"]),
        "drop_column": lambda: drop_column(df, op.column),
        "reorder_columns": lambda: reorder_columns(df, o["order"]),
        "handle_outliers": lambda: handle_outliers(df, op.column, o.get("method", "iqr"), o.get("action", "remove"), o.get("threshold", 1.5)),
    }
    need(op.name in steps, f"unknown operation {op.name!r}")
    return steps[op.name]()


def run_pipeline(df: DataFrame, operations: list[Operation], order: str | None = None) -> DataFrame:
    """The operations one after the other; the first that is refused stops the whole run. One plan, no copies between steps."""
    need(len(operations) <= MAX_OPERATIONS, f"at most {MAX_OPERATIONS} operations")
    for op in operations:
        df = apply_operation(df, op, order)
    return df


@dataclass
class Outcome:
    """What one operation of a run did."""

    index: int
    operation: str
    column: str | None
    rows_affected: int
    warning: str | None = None


def _reads_again(op: Operation) -> bool:
    """Whether an operation needs a statistic, an order or a check of its whole frame before it can change it."""
    return op.name == "handle_outliers" or op.name == "fill_missing" and op.options.get("strategy") != "custom" or op.name == "convert_type" and not op.options.get("errors_to_null", False)


def run_tracked(df: DataFrame, operations: list[Operation], order: str | None = None) -> tuple[DataFrame, list[Outcome]]:
    """The cleaned frame, written to the shared folder, and what each operation did. Counts are gathered while frames are written, in no pass of their own.

    Rows affected are cells filled, values lost by a conversion (with a warning), values moved to the bounds, or rows removed. Each
    operation gets observed aggregates behind it: how many rows are left and, where it changes cells, how many of these differ from what they
    were. What they were is a column that goes right after. An operation that reads its frame more than once gets it written first: observed
    aggregates count what runs, so nothing above them may run twice.
    """
    need(len(operations) <= MAX_OPERATIONS, f"at most {MAX_OPERATIONS} operations")
    run, before = uuid.uuid4().hex, fresh(df, "before")
    seen = [Observation(f"rows-{run}-start")]
    out = df.observe(seen[0], F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("cells"))
    for i, op in enumerate(operations):
        now = Observation(f"rows-{run}-{i}")
        if _reads_again(op):
            out = written(out)
        changed = F.lit(0).cast("long")
        if op.name in CELLS and not (op.name == "handle_outliers" and op.options.get("action", "remove") == "remove"):
            while before in out.columns:
                before += "_"
            c = quoted(op.column)
            done = apply_operation(out.withColumn(before, c), op, order)
            was = quoted(before)
            changed = F.count_if({"fill_missing": was.isNull() & c.isNotNull(), "convert_type": was.isNotNull() & c.isNull(), "handle_outliers": was.cast("double") != c}[op.name])
            out = done.observe(now, F.count(F.lit(1)).alias("rows"), changed.alias("cells")).drop(before)
        else:
            out = apply_operation(out, op, order).observe(now, F.count(F.lit(1)).alias("rows"), changed.alias("cells"))
        seen.append(now)
    cleaned = written(out)
    counts = [x.get for x in seen]
    made = []
    for i, op in enumerate(operations):
        rows, cells = counts[i]["rows"] - counts[i + 1]["rows"], counts[i + 1]["cells"]
        affected = cells if op.name in CELLS and cells else rows
        lost = op.name == "convert_type" and cells
        made.append(Outcome(i, op.name, op.column, affected, f"{cells} values of {op.column!r} could not be converted and are now empty" if lost else None))
    return cleaned, made


def affected_columns(before: DataFrame, after: DataFrame, operations: list[Operation]) -> list[str]:
    """Columns that an operation names, or that came, went or changed their type."""
    old, new = dict(before.dtypes), dict(after.dtypes)
    return sorted({op.column for op in operations if op.column} | (set(old) ^ set(new)) | {c for c in new if c in old and old[c] != new[c]})


def preview_operations(df: DataFrame, operations: list[Operation], order: str | None = None, sample: int = 20) -> dict[str, Any]:
    """preview() of a run that is not kept as a version, with outcomes, warnings, rows removed and affected columns."""
    after, outcomes = run_tracked(df, operations, order)
    shown = preview(df, after, sample)
    removed = max(shown["before"]["row_count"] - shown["after"]["row_count"], 0)
    return shown | {"rows_removed": removed, "affected_columns": affected_columns(df, after, operations), "operations": [asdict(x) for x in outcomes], "warnings": [x.warning for x in outcomes if x.warning]}


def apply_as_version(versions: Versions, operations: list[Operation], source: int | None = None, order: str | None = None) -> tuple[int, list[Outcome]]:
    """Clean a version (the latest if none is named) into a new one; both its number and the outcomes."""
    base = versions.get(source)["version"]
    cleaned, outcomes = run_tracked(versions.read(base), operations, order)
    return versions.add(cleaned, as_manifest(operations), base), outcomes


def preview(before: DataFrame, after: DataFrame, sample: int = 20) -> dict[str, Any]:
    """Rows, columns, missing cells and duplicates before and after, changed types, and a few rows."""
    from .profile import profile_dataset

    kinds = dict(before.dtypes)
    return {
        "before": profile_dataset(before).first().asDict(),
        "after": profile_dataset(after).first().asDict(),
        "type_changes": {c: [kinds[c], k] for c, k in after.dtypes if c in kinds and kinds[c] != k},
        "dropped": [c for c in before.columns if c not in after.columns],
        "added": [c for c in after.columns if c not in before.columns],
        "sample": [r.asDict() for r in after.limit(sample).collect()],
    }


def as_manifest(operations: list[Operation]) -> list[dict[str, Any]]:
    return [asdict(o) for o in operations]


def from_manifest(rows: list[dict[str, Any]]) -> list[Operation]:
    try:
        return [Operation(**r) for r in rows]
    except TypeError as e:
        raise RequestError(f"not a list of operations: {e}") from e
