"""Profiles, column roles, exploratory summaries and rule-based quality, over all columns in few passes."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import DATE_LEAST, DATE_SHAPE, DATE_SHARE, as_timestamp, parse_date
from ..functions.quantiles import quantiles
from ..functions.stats import percent
from ..plans.compile import is_date, is_number, kind_of, number, quoted
from ..plans.requests import Metric, RequestError, need

# What names an identifier, how many values make a dimension or a key, the quality rules' limits and placeholders.
ID_NAME = re.compile(r"(_id$|^id$|code|number|no\.?$|uuid|key)", re.I)
MAX_DIMENSION, KEY_SHARE, TEXT_KEY_SHARE = 1000, 0.95, 0.9
TOP_VALUES = 10
MAX_FILTER_VALUES = 50
MISSING_CRITICAL, MISSING_WARNING, DUPLICATE_CRITICAL, WRONG_TYPE, MIXED_TYPES = 50.0, 5.0, 10.0, 90.0, 10.0
PLACEHOLDERS = ("n/a", "na", "null", "none", "nil", "-", "--", "?", "unknown", "#n/a", "nan", "")
PENALTY = {"critical": 20, "warning": 8, "info": 2}

#: Distinct values that a column's sketch holds, 8 bytes each; and how far an estimate beyond may be off.
LOG_SKETCHED = 14
WHOLE = ("tinyint", "smallint", "int", "bigint")
SKETCHED, SKETCH_ERROR = 1 << LOG_SKETCHED, 4 / (1 << LOG_SKETCHED) ** 0.5


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it comes from fewer files than there are: work that is heavy for each row would keep to the few tasks that read them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df._jdf.inputFiles()) < cores else df


def _atomic(df: DataFrame) -> list[str]:
    """Columns of scalar type; arrays, maps and structs are passed by."""
    return [c for c, k in df.dtypes if not k.startswith(("array", "map", "struct", "binary", "variant"))]


def _long(df: DataFrame, columns: list[str], cells: dict[str, Any]) -> DataFrame:
    """column and the given aggregates for each column: one pass, one row a column."""
    structs = [F.struct(F.lit(c).alias("column"), *(make(c).alias(name) for name, make in cells.items())).alias(f"c{i}") for i, c in enumerate(columns)]
    one = df.agg(*structs)
    return one.select(F.explode(F.array(*(F.col(f"c{i}") for i in range(len(columns))))).alias("x")).select("x.*")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct_count, exact. Values are reduced to distinct (column, value) pairs by one shuffle, whatever the number of columns.

    Each row gives a row a column; the pairs are pre-aggregated before the shuffle, so a hot value costs a row a task.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("v")) for c in columns)))
    long = df.select(pairs.alias("x")).select("x.*").where("v IS NOT NULL").distinct()
    return long.groupBy("column").agg(F.count("*").alias("distinct_count"))


def _surveyed(df: DataFrame, columns: list[str], counted: list[str]) -> dict[str, dict[str, Any]]:
    """For each column in one read: rows, n (values; of columns that are neither text nor counted only whether there are any), for text the shares of numbers and of dates, and for those in `counted` the distinct values.

    Each row gives a row a column, so that one small expression, which compiles well, tests all text. Grouping by column, it is pre-aggregated
    where the rows are.
    """
    kinds = dict(df.dtypes)
    read = [c for c in columns if kinds[c] == "string" or c in counted]
    # of the other columns all that counts is whether they hold anything: a bit each
    rest = [c for c in columns if c not in read]
    words = [rest[i : i + 63] for i in range(0, len(rest), 63)]
    bits = [reduce(lambda a, b: a + b, (F.when(quoted(c).isNotNull(), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, c in enumerate(word))).alias(f"b{w}") for w, word in enumerate(words)]
    dealt = spread(df.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(read)), *bits))
    cell = lambda c, v: F.struct(F.lit(columns.index(c)).alias("i"), F.lit(kinds[c] == "string").alias("text"), F.lit(c in counted).alias("counted"), v.alias("v"), F.lit(0).cast("long").alias("bits"))
    cells = [cell(c, F.col(f"c{i}").cast("string")) for i, c in enumerate(read)]
    cells += [F.struct(F.lit(-1 - w).alias("i"), F.lit(False).alias("text"), F.lit(False).alias("counted"), F.lit(None).cast("string").alias("v"), F.col(f"b{w}").alias("bits")) for w in range(len(words))]
    long = dealt.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    t = F.when(F.col("text"), F.trim("v"))
    # most text is told by its first character, without a pattern; dates may begin with a month of three letters
    head = F.ascii(t)
    numeric = head.between(ord("0"), ord("9")) | head.isin(*map(ord, "+-."))
    share = lambda found: F.avg(F.when(t.isNotNull(), F.coalesce(found.cast("int"), F.lit(0))))
    number_like = F.when(numeric, t.rlike(r"^[-+]?\d*\.?\d+$"))
    date_like = F.when(numeric | (F.substring(t, 4, 1) == " "), t.rlike(DATE_SHAPE) & parse_date(t).isNotNull())
    # values go in by their hash, as the sketch leaves out empty text
    sketch = F.theta_sketch_estimate(F.theta_sketch_agg(F.when(F.col("counted") & F.col("v").isNotNull(), F.xxhash64("v")), LOG_SKETCHED))
    out = long.groupBy("i").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), share(number_like).alias("num"), share(date_like).alias("date"), sketch.alias("distinct"), F.bit_or("bits").alias("bits"))
    rows = {r["i"]: r.asDict() for r in out.collect()}  # a row a column
    none = {"rows": 0, "n": 0, "num": None, "date": None, "distinct": 0, "bits": 0}
    found = {c: rows.get(columns.index(c), none) for c in read}
    for w, word in enumerate(words):
        r = rows.get(-1 - w, none)
        found |= {c: r | {"n": r["bits"] >> j & 1} for j, c in enumerate(word)}
    return {c: found[c] for c in columns}


def _types(df: DataFrame, found: Mapping[str, Mapping[str, Any]]) -> dict[str, str]:
    kinds, out = dict(df.dtypes), {}
    for c, r in found.items():
        k = kinds[c]
        if r["n"] == 0:
            out[c] = "empty"
        elif k == "boolean":
            out[c] = "boolean"
        elif k in WHOLE:
            out[c] = "integer"
        elif is_number(k):
            out[c] = "float"
        elif is_date(k):
            out[c] = "datetime"
        else:
            dates = k == "string" and r["n"] >= DATE_LEAST and r["num"] < 1 and r["date"] >= DATE_SHARE
            out[c] = "datetime" if dates else "string"
    return out


def detect_types(df: DataFrame) -> dict[str, str]:
    """integer, float, boolean, datetime, string or empty for each scalar column. Text is read for dates in the same pass."""
    columns = _atomic(df)
    return _types(df, _surveyed(df, columns, [])) if columns else {}


def profile_columns(df: DataFrame) -> DataFrame:
    """column, row_count, null_count, null_pct, non_null_count, distinct_count, distinct_pct."""
    columns = _atomic(df)
    base = _long(df, columns, {"row_count": lambda c: F.count(F.lit(1)), "non_null_count": lambda c: F.count(quoted(c))})
    out = base.join(distinct_counts(df, columns), "column", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    nulls = F.col("row_count") - F.col("non_null_count")
    return out.select("column", "row_count", nulls.alias("null_count"), percent(nulls, F.col("row_count")).alias("null_pct"), "non_null_count", "distinct_count", percent(F.col("distinct_count"), F.col("non_null_count")).alias("distinct_pct"))


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, max, mean, median, std, sum and exact quartiles of numeric columns, all columns together."""
    made = {"n": lambda c: F.count(number(df, c)), "min_value": lambda c: F.min(number(df, c)), "max_value": lambda c: F.max(number(df, c)), "mean_value": lambda c: F.avg(number(df, c)), "std_dev": lambda c: F.stddev_samp(number(df, c)), "sum_value": lambda c: F.sum(number(df, c))}
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), number(df, c).alias("v")) for c in columns)))
    q = quantiles(df.select(values.alias("x")).select("x.*"), ["column"], "v", (0.25, 0.5, 0.75), few=True)
    out = _long(df, columns, made).join(F.broadcast(q.select("column", "q")), "column", "left")  # a row a column
    return out.select("column", "n", "min_value", "max_value", "mean_value", "std_dev", "sum_value", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median_value"), F.col("q")[2].alias("p75"))


def top_values(df: DataFrame, column: str, limit: int = TOP_VALUES) -> DataFrame:
    """rank, value, n, pct of the most frequent values; ties by value."""
    kind_of(df, column)
    counts = df.where(quoted(column).isNotNull()).groupBy(quoted(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "value").limit(limit)
    out = top.join(F.broadcast(total)).select("value", "n", percent(F.col("n"), F.col("total")).alias("pct"))  # total: one row
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def datetime_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, min, max, span_days, missing (null or unreadable) of date columns."""
    kinds = dict(df.dtypes)
    t = lambda c: as_timestamp(quoted(c), kinds[c])
    return _long(df, columns, {"min_value": lambda c: F.min(t(c)), "max_value": lambda c: F.max(t(c)), "span_days": lambda c: F.datediff(F.max(t(c)), F.min(t(c))), "missing_count": lambda c: F.count_if(t(c).isNull())})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: row_count, duplicate_count (all copies after the first; nulls are equal), duplicate_pct.

    Rows are compared whole, by grouping on their columns; copies are pre-aggregated before the shuffle.
    """
    columns = [quoted(c) for c, k in df.dtypes if not k.startswith(("map", "variant"))]
    groups = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    out = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_count"))
    return out.select("row_count", "duplicate_count", percent(F.col("duplicate_count"), F.col("row_count")).alias("duplicate_pct"))


def profile_dataset(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows."""
    columns = _atomic(df)
    missing = F.lit(0).cast("long")
    for c in columns:
        missing = missing + F.count_if(quoted(c).isNull())
    out = df.agg(missing.alias("missing_cells"))
    return duplicate_rows(df).join(F.broadcast(out)).select("row_count", F.lit(len(df.columns)).alias("column_count"), "missing_cells", "duplicate_count", "duplicate_pct")  # both one row


def describe_columns(df: DataFrame, exact: bool = True) -> list[dict[str, Any]]:
    """For each scalar column what it can be used for: numeric, temporal, categorical, identifier, measure; distinct is None where no use depends on it.

    One read of the frame tells all columns: their types, and a sketch of each one's distinct values that holds SKETCHED at most. A count up to that is
    exact; beyond, it is an estimate within SKETCH_ERROR (4 standard errors), and the column is counted in a second read. Uses are the same without that: not
    exact leaves estimates, but for a column whose share of distinct values an estimate cannot tell from the limit.
    """
    columns = _atomic(df)
    if not columns:
        return []
    counted = [c for c, k in df.dtypes if c in columns and not is_date(k) and (not is_number(k) or k in WHOLE and not ID_NAME.search(c))]
    found = _surveyed(df, columns, counted)
    types, n = _types(df, found), max(found[columns[0]]["rows"], 1)
    counts = {c: found[c]["distinct"] or 0 for c in counted}

    def unclear(c: str) -> bool:
        limit = KEY_SHARE if types[c] == "integer" else TEXT_KEY_SHARE
        matters = types[c] in ("integer", "string", "boolean") and not ID_NAME.search(c) and (types[c] == "integer" or counts.get(c, 0) <= MAX_DIMENSION)
        return matters and counts.get(c, 0) > SKETCHED and abs(counts[c] / n - limit) <= SKETCH_ERROR * counts[c] / n

    # an estimate may be below what a sketch holds
    estimated = lambda c: counts.get(c, 0) > SKETCHED * (1 - SKETCH_ERROR)
    if again := [c for c in columns if unclear(c) or exact and estimated(c)]:
        counts |= {x["column"]: x["distinct_count"] for x in distinct_counts(df, again).collect()}  # a row a column
    out = []
    for c, kind in types.items():
        numeric, temporal = kind in ("integer", "float"), kind == "datetime"
        # numbers that are told by type or name are not counted
        named, distinct = bool(ID_NAME.search(c)), counts.get(c)
        unique = min(1.0, (distinct or 0) / n)
        if numeric:
            identifier = named or (kind == "integer" and (distinct or 0) > 1 and unique >= KEY_SHARE)
        else:
            identifier = not temporal and distinct is not None and distinct > 1 and (named or distinct > MAX_DIMENSION or unique > TEXT_KEY_SHARE)
        categorical = not numeric and not temporal and not identifier and 0 < (distinct or 0) <= MAX_DIMENSION
        out.append({"column": c, "type": kind, "distinct": distinct, "numeric": numeric, "temporal": temporal, "identifier": identifier, "categorical": categorical, "measure": numeric and not identifier})
    return out


def filter_options(df: DataFrame, values: int = 100, most: int = 200) -> dict[str, dict[str, Any]]:
    """For each column what a filter can offer: a date range, a number range, or the most frequent values if there are few."""
    roles = describe_columns(df, exact=most > MAX_DIMENSION)
    out: dict[str, dict[str, Any]] = {}
    dates, numbers = [r["column"] for r in roles if r["temporal"]], [r["column"] for r in roles if r["numeric"]]
    for r in datetime_stats(df, dates).collect() if dates else []:
        out[r["column"]] = {"kind": "date", "min": r["min_value"], "max": r["max_value"]}
    for r in numeric_stats(df, numbers).collect() if numbers else []:
        out[r["column"]] = {"kind": "number", "min": r["min_value"], "max": r["max_value"]}
    for r in roles:
        if not r["numeric"] and not r["temporal"] and 0 < (r["distinct"] or 0) <= most:
            out[r["column"]] = {"kind": "values", "values": [x["value"] for x in top_values(df, r["column"], values).collect()]}
    return out


def filter_values(df: DataFrame, column: str, most: int = MAX_FILTER_VALUES) -> list[str]:
    """A column's most frequent values, for a filter to offer; ties by value."""
    return [r["value"] for r in top_values(df, column, most).collect()]


def period_labels(df: DataFrame, date_column: str, most: int = MAX_FILTER_VALUES) -> list[str]:
    """Labels of a date column's first periods, of the length that suits its span; periods without rows are among them. None for a column without dates."""
    from .timeseries import period_for, time_series

    try:
        series = time_series(df, date_column, period_for(df, date_column), Metric("count"))
    except RequestError:
        return []
    return [r["label"] for r in series.orderBy("bucket").limit(most).collect()]


def text_checks(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, numeric_count, placeholder_count of text columns, in one pass."""
    t = lambda c: F.trim(quoted(c).cast("string"))
    # most text is told by its first character, without a pattern
    numeric = lambda c: F.ascii(t(c)).between(ord("0"), ord("9")) | F.ascii(t(c)).isin(*map(ord, "+-."))
    number_like = lambda c: numeric(c) & t(c).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    return _long(df, columns, {"n": lambda c: F.count(quoted(c)), "numeric_count": lambda c: F.count_if(number_like(c)), "placeholder_count": lambda c: F.count_if(F.lower(t(c)).isin(*PLACEHOLDERS))})


def quality_issues(df: DataFrame, types: Mapping[str, str] | None = None) -> list[dict[str, Any]]:
    """Issues by severity and column: each with kind, severity, column, rows, pct and the operations that would mend it. types: detect_types(), where they are known."""
    issues = []

    def add(kind: str, severity: str, column: str | None, rows: int, pct: float, *mend: str) -> None:
        issues.append({"kind": kind, "severity": severity, "column": column, "rows": rows, "pct": pct, "operations": list(mend)})

    d = duplicate_rows(df).first()
    if d["duplicate_count"]:
        add("duplicate_rows", "critical" if d["duplicate_pct"] >= DUPLICATE_CRITICAL else "warning", None, d["duplicate_count"], d["duplicate_pct"], "remove_duplicates")
    # whether a column is constant needs its ends, not its distinct values
    ends = {"n": lambda c: F.count(quoted(c)), "row_count": lambda c: F.count(F.lit(1)), "one": lambda c: F.coalesce(F.min(quoted(c)) == F.max(quoted(c)), F.lit(False))}
    counts = _long(df, _atomic(df), ends).withColumn("null_count", F.col("row_count") - F.col("n")).withColumn("null_pct", percent(F.col("null_count"), F.col("row_count")))
    for r in counts.collect():
        c, missing, pct = r["column"], r["null_count"], r["null_pct"]
        if missing and not r["n"]:
            add("empty_column", "critical", c, missing, pct, "drop_column")
        elif pct >= MISSING_CRITICAL:
            add("high_missing", "critical", c, missing, pct, "fill_missing", "drop_column", "drop_missing_rows")
        elif missing:
            add("missing_values", "warning" if pct > MISSING_WARNING else "info", c, missing, pct, "fill_missing", "drop_missing_rows")
        if r["one"]:
            add("constant_column", "warning", c, r["n"], 100.0, "drop_column")
    text = [c for c, kind in (detect_types(df) if types is None else types).items() if kind == "string"]
    for r in text_checks(df, text).collect() if text else []:
        if not r["n"]:
            continue
        numeric = round(100 * r["numeric_count"] / r["n"], 2)
        if numeric >= WRONG_TYPE:
            add("possible_wrong_type", "warning", r["column"], r["numeric_count"], numeric, "convert_type")
        elif numeric >= MIXED_TYPES and round(100 - numeric, 2) >= MIXED_TYPES:
            add("mixed_types", "warning", r["column"], r["numeric_count"], numeric, "convert_type", "fill_missing")
        if r["placeholder_count"]:
            add("suspicious_values", "warning", r["column"], r["placeholder_count"], round(100 * r["placeholder_count"] / r["n"], 2), "fill_missing")
    rank = {"critical": 0, "warning": 1, "info": 2}
    return sorted(issues, key=lambda x: (rank[x["severity"]], x["column"] or ""))


def quality_score(issues: list[dict[str, Any]]) -> tuple[int, str]:
    """0 to 100, and good, warning or critical."""
    score = max(0, min(100, 100 - sum(PENALTY[x["severity"]] for x in issues)))
    seen = {x["severity"] for x in issues}
    return score, "critical" if "critical" in seen else "warning" if "warning" in seen else "good"


def eda_summary(df: DataFrame) -> dict[str, list[dict[str, Any]]]:
    """Statistics by type: numbers, categories, dates."""
    types = detect_types(df)
    need(types, "there are no scalar columns")
    numbers, dates, text = ([c for c, k in types.items() if k in kinds] for kinds in (("integer", "float"), ("datetime",), ("string", "boolean")))
    as_rows = lambda x: [r.asDict() for r in x.collect()]
    return {"numeric": as_rows(numeric_stats(df, numbers)) if numbers else [], "datetime": as_rows(datetime_stats(df, dates)) if dates else [], "categorical": [{"column": c, "top": as_rows(top_values(df, c))} for c in text]}
