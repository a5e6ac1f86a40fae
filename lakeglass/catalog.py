"""The operators applied to the test tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import charts, cleaning, customers, distribution, forecast, insights, profile, query, questions, ranking, runs, segmentation, timeseries
from .plans.compile import apply_filters
from .plans.requests import Aggregate, Binary, Condition, Constant, FilterSet, Kpi, Metric, Query
from .sources.storage import Datasets, Versions, shared_dir
from .sources.tables import events, lineitem, orders, wide

Make = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Make] = {}
ORACLES: dict[str, str] = {}

L = "(SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)"
W = "(SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"
N = "(SELECT *, nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)"


def plain(df: DataFrame, places: int = 2) -> DataFrame:
    """Doubles rounded, whole numbers as bigint, timestamps as text: what both engines agree on."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind == "double":
            x = F.round(x, places)
        elif kind in ("int", "smallint", "tinyint"):
            x = x.cast("bigint")
        elif kind.startswith("timestamp") or kind == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        out.append(x.alias(c))
    return df.select(*out)


def query_of(sql: str | None = None, places: int = 2) -> Callable[[Make], Make]:
    def add(make: Make) -> Make:
        QUERIES[make.__name__] = lambda spark, sf_dir: plain(make(spark, sf_dir), places)
        if sql:
            ORACLES[make.__name__] = sql
        return make

    return add


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with nulls in two derived columns."""
    return orders(spark, sf_dir).withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW"))).withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))


def where(*conditions: Condition, combine: str = "and") -> FilterSet:
    return FilterSet(conditions, combine)


# filters

FILTERS: dict[str, tuple[FilterSet, str]] = {
    "flt_equals": (where(Condition("o_orderstatus", "equals", "F")), "o_orderstatus = 'F'"),
    "flt_equals_number": (where(Condition("o_custkey", "equals", "37")), "o_custkey = 37"),
    "flt_not_equals": (where(Condition("priority", "not_equals", "1-URGENT")), "priority IS DISTINCT FROM '1-URGENT'"),
    "flt_contains": (where(Condition("priority", "contains", "HiGh")), "contains(lower(priority), 'high')"),
    "flt_gt": (where(Condition("o_totalprice", "greater_than", 200000)), "o_totalprice > 200000"),
    "flt_gte_date": (where(Condition("o_orderdate", "greater_or_equal", "1998-01-01")), "o_orderdate >= TIMESTAMP '1998-01-01'"),
    "flt_lt": (where(Condition("o_totalprice", "less_than", 50000)), "o_totalprice < 50000"),
    "flt_lte": (where(Condition("o_custkey", "less_or_equal", 100)), "o_custkey <= 100"),
    "flt_between": (where(Condition("o_totalprice", "between", 300000, 100000)), "o_totalprice BETWEEN 100000 AND 300000"),
    "flt_is_null": (where(Condition("priority", "is_null")), "priority IS NULL"),
    "flt_is_not_null": (where(Condition("price", "is_not_null")), "price IS NOT NULL"),
    "flt_or": (where(Condition("o_orderstatus", "equals", "F"), Condition("price", "is_null"), combine="or"), "o_orderstatus = 'F' OR price IS NULL"),
}


def _filter(name: str, filters: FilterSet, sql: str) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_filters(holed(spark, sf_dir), filters).select("o_orderkey", "priority", "price")

    make.__name__ = name
    query_of(f"SELECT o_orderkey, priority, round(price, 2) AS price FROM {N} WHERE {sql}")(make)


for _name, (_set, _sql) in FILTERS.items():
    _filter(_name, _set, _sql)


# generic query


@query_of(f"SELECT l_returnflag, l_linestatus, round(sum(revenue), 2) AS sum_revenue, round(avg(l_quantity), 2) AS mean_l_quantity, round(median(l_discount), 2) AS median_l_discount, count(l_tax) AS count_l_tax, strftime(min(l_shipdate), '%Y-%m-%d') AS first_ship, round(max(l_tax), 2) AS max_l_tax FROM {L} GROUP BY ALL")
def qry_group_agg(spark, sf_dir):
    made = (Aggregate("sum", "revenue"), Aggregate("mean", "l_quantity"), Aggregate("median", "l_discount"), Aggregate("count", "l_tax"), Aggregate("min", "l_shipdate", "first_ship"), Aggregate("max", "l_tax"))
    return query.run_query(lineitem(spark, sf_dir), Query(group_by=("l_returnflag", "l_linestatus"), aggregations=made))


@query_of(f"SELECT count(*) AS count_rows, round(coalesce(sum(price), 0), 2) AS sum_price FROM {N} WHERE price > 1000")
def qry_global_agg(spark, sf_dir):
    return query.run_query(holed(spark, sf_dir), Query(where(Condition("price", "greater_than", 1000)), aggregations=(Aggregate("count"), Aggregate("sum", "price"))))


@query_of("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC LIMIT 50")
def qry_project_sort_limit(spark, sf_dir):
    return query.run_query(orders(spark, sf_dir), Query(where(Condition("o_orderstatus", "equals", "O")), columns=("o_orderkey", "o_totalprice"), sort_by="o_totalprice", sort_desc=True, limit=50))


@query_of(f"SELECT priority, count(*) AS count_rows FROM {N} GROUP BY 1")
def qry_null_group(spark, sf_dir):
    return query.run_query(holed(spark, sf_dir), Query(group_by=("priority",), aggregations=(Aggregate("count"),)))


@query_of("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def qry_preview_page(spark, sf_dir):
    return query.preview(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), 3, 25, "o_orderkey")


# metrics and formulas

_METRICS = {"count_rows": "count(*)", "count": "count({c})", "distinct": "count(DISTINCT {c})", "sum": "sum({c})", "average": "avg({c})", "median": "median({c})", "min": "min({c})", "max": "max({c})", "range": "max({c}) - min({c})", "std_dev": "stddev_samp({c})"}


@query_of(" UNION ALL ".join(f"SELECT '{name}' AS metric, round(CAST({sql.format(c='l_quantity')} AS DOUBLE), 2) AS value FROM lineitem" for name, sql in _METRICS.items()))
def kpi_metrics(spark, sf_dir):
    names = {"distinct": "distinct_count", "count_rows": "count"}
    return query.metrics(lineitem(spark, sf_dir), {n: Metric(names.get(n, n), None if n == "count_rows" else "l_quantity") for n in _METRICS})


@query_of(f"SELECT 'revenue_per_order' AS metric, round(sum(revenue) / count(DISTINCT l_orderkey), 2) AS value FROM {L} UNION ALL SELECT 'margin', round(sum(revenue) * 0.3 - count(*), 2) FROM {L}")
def kpi_formula_ratio(spark, sf_dir):
    revenue = Metric("sum", "revenue")
    return query.metrics(lineitem(spark, sf_dir), {"revenue_per_order": Binary("/", revenue, Metric("distinct_count", "l_orderkey")), "margin": Binary("-", Binary("*", revenue, Constant(0.3)), Metric("count"))})


@query_of("SELECT 'div0' AS metric, CAST(NULL AS DOUBLE) AS value")
def kpi_formula_div0(spark, sf_dir):
    return query.metrics(lineitem(spark, sf_dir), {"div0": Binary("/", Metric("sum", "l_tax"), Constant(0))})


@query_of(f"SELECT 'returned_pct' AS kpi, round(100 * sum(revenue) FILTER (l_returnflag = 'R') / sum(revenue), 2) AS value FROM {L} UNION ALL SELECT 'big', CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_quantity >= 40")
def kpi_filtered_metric(spark, sf_dir):
    returned = Metric("sum", "revenue", where(Condition("l_returnflag", "equals", "R")))
    share = Binary("*", Constant(100), Binary("/", returned, Metric("sum", "revenue")))
    return query.kpis(lineitem(spark, sf_dir), [Kpi("returned_pct", formula=share), Kpi("big", Metric("count"), filters=where(Condition("l_quantity", "greater_or_equal", 40)))])


@query_of(f"SELECT coalesce(n_name, '(empty)') AS label, round(sum(revenue), 2) AS value FROM {W} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def kpi_groups(spark, sf_dir):
    return query.kpi_groups(wide(spark, sf_dir), Kpi("revenue", Metric("sum", "revenue"), group_by="n_name"))


@query_of("WITH m AS (SELECT date_trunc('month', o_orderdate) AS b, sum(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT *, lag(v) OVER (ORDER BY b) AS p FROM m) SELECT strftime(b, '%Y-%m') AS label, round(v, 2) AS current_value, round(p, 2) AS previous_value, round(v - p, 2) AS change_value, round((v - p) / p * 100, 2) AS change_pct FROM s ORDER BY b DESC LIMIT 1")
def kpi_comparison(spark, sf_dir):
    return query.kpi_comparison(orders(spark, sf_dir), Kpi("sales", Metric("sum", "o_totalprice")), "o_orderdate", "month")


@query_of("SELECT 'either' AS kpi, round(sum(o_totalprice) FILTER (o_orderstatus = 'F' OR o_custkey < 50), 2) AS value, true AS available, NULL AS reason FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'unknown', NULL, false, 'unknown column ''o_weight''' UNION ALL SELECT 'text', NULL, false, 'sum needs a number, and ''o_orderstatus'' is string' UNION ALL SELECT 'nothing', NULL, false, 'no value'")
def kpi_availability(spark, sf_dir):
    either = where(Condition("o_orderstatus", "equals", "F"), Condition("o_custkey", "less_than", 50), combine="or")
    dear, none = where(Condition("o_totalprice", "greater_than", 100000)), where(Condition("o_totalprice", "less_than", 0))
    price = Metric("sum", "o_totalprice")
    return query.evaluate_kpis(orders(spark, sf_dir), [Kpi("either", Metric("sum", "o_totalprice", either), filters=dear), Kpi("unknown", Metric("sum", "o_weight")), Kpi("text", Metric("sum", "o_orderstatus")), Kpi("nothing", price, filters=none)])


# grouped analytics


@query_of(f"SELECT l_returnflag AS label, round(sum(revenue), 2) AS value, round(100 * sum(revenue) / sum(sum(revenue)) OVER (), 2) AS share_pct, count(*) OVER () AS group_count FROM {L} GROUP BY 1")
def seg_share(spark, sf_dir):
    return ranking.segment(lineitem(spark, sf_dir), "l_returnflag", Metric("sum", "revenue"))


@query_of(f"SELECT row_number() OVER (ORDER BY sum(revenue), p_brand) AS rank, p_brand AS label, round(sum(revenue), 2) AS value, round(100 * sum(revenue) / sum(sum(revenue)) OVER (), 2) AS share_pct, count(*) OVER () AS group_count FROM {W} GROUP BY p_brand ORDER BY 1 LIMIT 5")
def seg_bottom(spark, sf_dir):
    return ranking.ranking(wide(spark, sf_dir), "p_brand", Metric("sum", "revenue"), top=False, limit=5).select("rank", "label", "value", "share_pct", "group_count")


@query_of("SELECT CAST(o_custkey AS VARCHAR) AS label, round(sum(o_totalprice), 2) AS value, round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 2) AS share_pct, count(*) OVER () AS group_count FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 20")
def seg_customers(spark, sf_dir):
    return ranking.segment(orders(spark, sf_dir), "o_custkey", Metric("sum", "o_totalprice"))


_BUYERS = "WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS label, sum(o_totalprice) AS v FROM orders GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY v DESC, label) AS rank, label, v, 100 * v / sum(v) OVER () AS share, 100 * sum(v) OVER (ORDER BY v DESC, label ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum, count(*) OVER () AS group_count FROM g) "


@query_of(_BUYERS + "SELECT rank, label, round(v, 2) AS value, round(share, 2) AS share_pct, round(cum, 2) AS cumulative_pct, group_count FROM c ORDER BY rank LIMIT 500")
def contribution_customers(spark, sf_dir):
    return ranking.contribution(orders(spark, sf_dir), "o_custkey", Metric("sum", "o_totalprice"))


@query_of(_BUYERS + "SELECT CASE WHEN cum <= 80 + 1e-9 THEN 'A' WHEN cum <= 95 + 1e-9 THEN 'B' ELSE 'C' END AS class, count(*) AS groups, round(sum(v), 2) AS value, round(100 * sum(v) / sum(sum(v)) OVER (), 2) AS value_pct FROM c GROUP BY 1")
def abc_customers(spark, sf_dir):
    return ranking.abc_summary(ranking.abc(orders(spark, sf_dir), "o_custkey", Metric("sum", "o_totalprice")))


@query_of(f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY price NULLS LAST, o_orderkey) AS rn FROM {N}) WHERE rn = 1")
def clean_dedupe_null_order(spark, sf_dir):
    return cleaning.remove_duplicates(holed(spark, sf_dir).select("o_custkey", "o_orderkey", "price"), ["o_custkey"], "price").select("o_custkey", "o_orderkey")


_CUM = f"WITH g AS (SELECT p_brand AS label, sum(revenue) AS v FROM {W} GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY v DESC, label) AS rank, label, v, 100 * v / sum(v) OVER () AS share, 100 * sum(v) OVER (ORDER BY v DESC, label ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum, count(*) OVER () AS group_count FROM g) "


@query_of(_CUM + "SELECT rank, label, round(v, 2) AS value, round(share, 2) AS share_pct, round(cum, 2) AS cumulative_pct, group_count FROM c")
def contribution(spark, sf_dir):
    return ranking.contribution(wide(spark, sf_dir), "p_brand", Metric("sum", "revenue"))


@query_of(_CUM + "SELECT rank, label, round(v, 2) AS value, round(share, 2) AS share_pct, round(cum, 2) AS cumulative_pct, CASE WHEN cum <= 80 + 1e-9 THEN 'A' WHEN cum <= 95 + 1e-9 THEN 'B' ELSE 'C' END AS class FROM c")
def abc_rows(spark, sf_dir):
    return ranking.abc(wide(spark, sf_dir), "p_brand", Metric("sum", "revenue"))


@query_of(_CUM + ", k AS (SELECT *, CASE WHEN cum <= 80 + 1e-9 THEN 'A' WHEN cum <= 95 + 1e-9 THEN 'B' ELSE 'C' END AS class FROM c) SELECT x.class, count(k.v) AS groups, round(coalesce(sum(v), 0), 2) AS value, round(coalesce(100 * sum(v) / sum(sum(v)) OVER (), 0), 2) AS value_pct FROM (VALUES ('A'), ('B'), ('C')) x(class) LEFT JOIN k ON k.class = x.class GROUP BY 1")
def abc_summary(spark, sf_dir):
    return ranking.abc_summary(ranking.abc(wide(spark, sf_dir), "p_brand", Metric("sum", "revenue")))


@query_of(_CUM + "SELECT rank, label, round(v, 2) AS value, round(share, 2) AS share_pct, round(cum, 2) AS cumulative_pct, group_count, coalesce(lag(cum) OVER (ORDER BY rank), 0) < 80 AS vital_few FROM c")
def pareto(spark, sf_dir):
    return ranking.pareto(wide(spark, sf_dir), "p_brand", Metric("sum", "revenue"))


@query_of("WITH e AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v, count(DISTINCT o_orderkey) AS t FROM orders GROUP BY 1) SELECT count(*) AS entities, count(*) FILTER (n > 1) AS repeat_entities, count(*) FILTER (n = 1) AS one_time_entities, round(avg(n), 2) AS records_per_entity, round(avg(t), 2) AS transactions_per_entity, round(sum(v), 2) AS total_value, round(avg(v), 2) AS value_per_entity, round(sum(v) / sum(n), 2) AS value_per_record, round(100.0 * count(*) FILTER (n > 1) / count(*), 2) AS repeat_pct FROM e")
def entity_summary(spark, sf_dir):
    return ranking.entity_summary(orders(spark, sf_dir), "o_custkey", "o_totalprice", "o_orderkey")


@query_of("SELECT CAST(o_custkey AS VARCHAR) AS entity, count(*) AS records, round(sum(o_totalprice), 2) AS total_value, round(avg(o_totalprice), 2) AS average_value FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, 1 LIMIT 20")
def entity_top(spark, sf_dir):
    return ranking.entity_top(orders(spark, sf_dir), "o_custkey", "o_totalprice")


# distributions


@query_of("SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS mean_value, round(median(o_totalprice), 2) AS median_value, round(min(o_totalprice), 2) AS min_value, round(max(o_totalprice), 2) AS max_value, round(stddev_samp(o_totalprice), 2) AS std_dev, " + ", ".join(f"round(quantile_cont(o_totalprice, {p / 100}), 2) AS p{p}" for p in (10, 25, 50, 75, 90, 95)) + " FROM orders")
def distribution_stats(spark, sf_dir):
    return distribution.distribution_stats(orders(spark, sf_dir), "o_totalprice")


@query_of("WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), k AS (SELECT greatest(1, least(10, CAST(ceil((o_totalprice - lo) / ((hi - lo) / 10)) AS BIGINT))) AS bin FROM orders, b) SELECT CAST(g.bin AS BIGINT) AS bin, round(lo + (hi - lo) / 10 * (g.bin - 1), 2) AS lower, round(lo + (hi - lo) / 10 * g.bin, 2) AS upper, count(k.bin) AS n FROM b, generate_series(1, 10) g(bin) LEFT JOIN k ON k.bin = g.bin GROUP BY 1, 2, 3")
def histogram(spark, sf_dir):
    return distribution.histogram(orders(spark, sf_dir), "o_totalprice", 10)


@query_of("WITH q AS (SELECT l_returnflag AS label, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1), r AS (SELECT q.*, l_extendedprice AS v, l_extendedprice BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM lineitem JOIN q ON l_returnflag = label) SELECT label, round(q1, 2) AS q1, round(q2, 2) AS median_value, round(q3, 2) AS q3, round(min(v) FILTER (inside), 2) AS whisker_low, round(max(v) FILTER (inside), 2) AS whisker_high, count(*) FILTER (NOT inside) AS outliers, count(*) AS n FROM r GROUP BY label, q1, q2, q3")
def box_stats(spark, sf_dir):
    return distribution.box_stats(lineitem(spark, sf_dir), "l_extendedprice", "l_returnflag")


_FIVE = "round(min(v), 2) AS min_value, round(quantile_cont(v, 0.25), 2) AS q1, round(median(v), 2) AS median_value, round(quantile_cont(v, 0.75), 2) AS q3, round(max(v), 2) AS max_value"


@query_of(f"WITH t AS (SELECT l_extendedprice AS v FROM lineitem), b AS (SELECT quantile_cont(v, 0.25) - (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) * 1.5 AS lo, quantile_cont(v, 0.75) + (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) * 1.5 AS hi FROM t) SELECT count(*) AS n, count(*) FILTER (v < lo OR v > hi) AS outliers, round(100.0 * count(*) FILTER (v < lo OR v > hi) / count(*), 2) AS outlier_pct, round(any_value(lo), 2) AS lower_bound, round(any_value(hi), 2) AS upper_bound, {_FIVE} FROM t, b")
def outliers_iqr(spark, sf_dir):
    return distribution.outliers(lineitem(spark, sf_dir), "l_extendedprice")


@query_of(f"WITH t AS (SELECT o_totalprice AS v FROM orders), b AS (SELECT avg(v) - 2 * stddev_samp(v) AS lo, avg(v) + 2 * stddev_samp(v) AS hi FROM t) SELECT count(*) AS n, count(*) FILTER (v < lo OR v > hi) AS outliers, round(100.0 * count(*) FILTER (v < lo OR v > hi) / count(*), 2) AS outlier_pct, round(any_value(lo), 2) AS lower_bound, round(any_value(hi), 2) AS upper_bound, {_FIVE} FROM t, b")
def outliers_zscore(spark, sf_dir):
    return distribution.outliers(orders(spark, sf_dir), "o_totalprice", "zscore", 2.0)


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query_of(" UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 4) AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS), 4)
def correlation(spark, sf_dir):
    return distribution.correlation_matrix(lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


# time series

_LABEL = {"day": "strftime(b, '%Y-%m-%d')", "week": "strftime(b, '%Y-W%V')", "month": "strftime(b, '%Y-%m')", "quarter": "year(b) || '-Q' || quarter(b)", "year": "strftime(b, '%Y')"}
_SPINE = {"day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH", "quarter": "3 MONTHS", "year": "1 YEAR"}


def _bucket(period: str, column: str) -> str:
    return f"CAST(date_trunc('{period}', {column}) AS DATE)" + (" + 6" if period == "week" else "")


def _series(period: str, table: str, column: str, value: str, condition: str = "true", gap: str = "NULL") -> str:
    return f"WITH g AS (SELECT {_bucket(period, column)} AS b, {value} AS v FROM {table} WHERE {condition} GROUP BY 1), a AS (SELECT CAST(unnest(generate_series(min(b), max(b), INTERVAL {_SPINE[period]})) AS DATE) AS b FROM g) SELECT strftime(a.b, '%Y-%m-%d') AS bucket, {_LABEL[period].replace('(b', '(a.b')} AS label, round(coalesce(v, {gap}), 2) AS value FROM a LEFT JOIN g ON g.b = a.b"


def _add_series(period: str) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        return timeseries.time_series(orders(spark, sf_dir), "o_orderdate", period, Metric("sum", "o_totalprice"), 2000) if period not in ("day", "week") else timeseries.time_series(events(spark, sf_dir), "ts", period, Metric("average", "value"), 2000)

    make.__name__ = f"ts_{period}"
    query_of(_series(period, "orders", "o_orderdate", "sum(o_totalprice)") if period not in ("day", "week") else _series(period, "events", "ts", "avg(value)"))(make)


for _period in _LABEL:
    _add_series(_period)


@query_of(_series("month", "orders", "o_orderdate", "count(*)", "o_totalprice > 400000", "0"))
def ts_gapfill(spark, sf_dir):
    rare = apply_filters(orders(spark, sf_dir), where(Condition("o_totalprice", "greater_than", 400000)))
    return timeseries.time_series(rare, "o_orderdate", "month", Metric("count"), 2000)


@query_of("SELECT strftime(b, '%Y-%m-%d') AS bucket, strftime(b, '%Y-%m-%d') AS label, series, round(v, 2) AS value FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS b, event_type AS series, sum(value) AS v FROM events GROUP BY 1, 2)")
def ts_grouped(spark, sf_dir):
    return timeseries.grouped_series(events(spark, sf_dir), "ts", "day", Metric("sum", "value"), "event_type")


@query_of("SELECT strftime(b, '%Y-%m-%d') AS bucket, strftime(b, '%Y-%m-%d') AS label, v AS value FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS b, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 5)")
def ts_truncate(spark, sf_dir):
    return timeseries.time_series(events(spark, sf_dir), "ts", "day", Metric("count"), 5)


@query_of("WITH g AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS b, sum(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT *, lag(v) OVER (ORDER BY b) AS p FROM g) SELECT strftime(b, '%Y-%m-%d') AS bucket, year(b) || '-Q' || quarter(b) AS label, round(v, 2) AS value, round(p, 2) AS previous_value, round(v - p, 2) AS change_value, round((v - p) / nullif(p, 0) * 100, 2) AS change_pct FROM s")
def growth(spark, sf_dir):
    return timeseries.growth(orders(spark, sf_dir), "o_orderdate", "quarter", Metric("sum", "o_totalprice"))


@query_of(f"WITH g AS (SELECT date_trunc('month', o_orderdate) AS b, r_name AS label, sum(revenue) AS v FROM {W} GROUP BY 1, 2), k AS (SELECT b, row_number() OVER (ORDER BY b DESC) AS age FROM (SELECT DISTINCT b FROM g)), p AS (SELECT label, max(v) FILTER (age = 1) AS n, max(v) FILTER (age = 2) AS o FROM g JOIN k USING (b) WHERE age <= 2 GROUP BY 1) SELECT label, round(n, 2) AS latest_value, round(o, 2) AS previous_value, round((n - o) / nullif(o, 0) * 100, 2) AS change_pct FROM p")
def dim_movement(spark, sf_dir):
    return timeseries.dimension_movement(wide(spark, sf_dir), "o_orderdate", "month", Metric("sum", "revenue"), "r_name")


@query_of("WITH m AS (SELECT month(o_orderdate) AS month, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1) SELECT month, round(v, 2) AS mean_value, n, round((v - avg(v) OVER ()) / avg(v) OVER () * 100, 2) AS lift_pct FROM m WHERE (SELECT count(DISTINCT date_trunc('month', o_orderdate)) FROM orders) >= 24")
def seasonality(spark, sf_dir):
    return timeseries.seasonality(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


# customers

_RFM = "WITH c AS (SELECT o_custkey AS customer, date_diff('second', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) // 86400 AS recency_days, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 0), k AS (SELECT *, row_number() OVER (ORDER BY recency_days, customer) AS r, row_number() OVER (ORDER BY frequency, customer) AS f, row_number() OVER (ORDER BY monetary, customer) AS m, count(*) OVER () AS n FROM c), s AS (SELECT *, 6 - CAST(greatest(1, ceil((r - 1) * 5.0 / (n - 1))) AS BIGINT) AS r_score, CAST(greatest(1, ceil((f - 1) * 5.0 / (n - 1))) AS BIGINT) AS f_score, CAST(greatest(1, ceil((m - 1) * 5.0 / (n - 1))) AS BIGINT) AS m_score FROM k), z AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 4 THEN 'Loyal Customers' WHEN r_score >= 4 AND f_score <= 3 AND m_score >= 3 THEN 'Potential Loyalists' WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers' WHEN r_score <= 2 AND f_score >= 4 AND m_score >= 4 THEN 'Can''t Lose Them' WHEN r_score <= 3 AND f_score >= 3 THEN 'At Risk' WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Lost' WHEN r_score <= 3 THEN 'Hibernating' ELSE 'Others' END AS segment FROM s) "


@query_of(_RFM + "SELECT customer, recency_days, frequency, round(monetary, 2) AS monetary, r_score, f_score, m_score, segment FROM z")
def rfm_customers(spark, sf_dir):
    return customers.rfm(orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_totalprice")


@query_of(_RFM + "SELECT segment, count(*) AS customers, round(sum(monetary), 2) AS total_value, round(avg(recency_days), 2) AS avg_recency, round(avg(frequency), 2) AS avg_frequency, round(avg(monetary), 2) AS avg_monetary, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS customers_pct, round(100 * sum(monetary) / sum(sum(monetary)) OVER (), 2) AS value_pct FROM z GROUP BY 1")
def rfm_segments(spark, sf_dir):
    return customers.rfm_segments(customers.rfm(orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_totalprice"))


_COHORT = "WITH p AS (SELECT DISTINCT o_custkey AS c, CAST(date_trunc('month', o_orderdate) AS DATE) AS p FROM orders), f AS (SELECT *, min(p) OVER (PARTITION BY c) AS cohort FROM p), k AS (SELECT cohort, date_diff('month', cohort, p) AS o, count(*) AS n FROM f GROUP BY 1, 2 HAVING o < 12), z AS (SELECT *, 100.0 * n / max(n) FILTER (o = 0) OVER (PARTITION BY cohort) AS pct FROM k) "


@query_of(_COHORT + "SELECT strftime(cohort, '%Y-%m-%d') AS cohort, strftime(cohort, '%Y-%m') AS label, o AS period_offset, n AS customers, round(pct, 2) AS retention_pct FROM z")
def cohort_matrix(spark, sf_dir):
    return customers.cohort_matrix(orders(spark, sf_dir), "o_custkey", "o_orderdate")


@query_of(_COHORT + "SELECT o AS period_offset, round(avg(pct), 2) AS retention_pct, count(*) AS cohorts FROM z GROUP BY 1")
def cohort_average(spark, sf_dir):
    return customers.cohort_average(customers.cohort_matrix(orders(spark, sf_dir), "o_custkey", "o_orderdate"))


_CHURN = "WITH c AS (SELECT o_custkey AS customer, max(o_orderdate) AS last_at, sum(o_totalprice) AS value FROM orders GROUP BY 1), d AS (SELECT *, date_diff('second', last_at, (SELECT max(o_orderdate) FROM orders)) // 86400 AS days FROM c), z AS (SELECT *, CASE WHEN days >= 90 THEN 'churned' WHEN days >= 45 THEN 'at_risk' ELSE 'active' END AS status FROM d) "


@query_of(_CHURN + "SELECT customer, strftime(last_at, '%Y-%m-%d') AS last_date, days AS inactive_days, round(value, 2) AS value, status FROM z")
def churn_customers(spark, sf_dir):
    return customers.churn_customers(orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_totalprice")


@query_of(_CHURN + "SELECT count(*) AS customers, count(*) FILTER (status = 'active') AS active_customers, count(*) FILTER (status = 'at_risk') AS at_risk_customers, count(*) FILTER (status = 'churned') AS churned_customers, round(sum(value) FILTER (status <> 'active'), 2) AS value_at_risk, round(100.0 * count(*) FILTER (status = 'churned') / count(*), 2) AS churn_rate FROM z")
def churn_summary(spark, sf_dir):
    return customers.churn_summary(customers.churn_customers(orders(spark, sf_dir), "o_custkey", "o_orderdate", "o_totalprice"))


@query_of("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(DISTINCT o_custkey) AS active_customers FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def churn_trend(spark, sf_dir):
    return customers.churn_trend(orders(spark, sf_dir), "o_custkey", "o_orderdate")


# forecasts and models

_MONTHS = "WITH RECURSIVE g AS (SELECT row_number() OVER (ORDER BY date_trunc('month', o_orderdate)) AS i, sum(o_totalprice) AS v FROM orders GROUP BY date_trunc('month', o_orderdate)), "
_AHEAD = ", q AS (SELECT stddev_samp(v - fit) AS s, avg(abs(v - fit)) AS mae, count(*) AS n FROM f) SELECT step, round(l + t * step, 2) AS value, round(l + t * step - s * sqrt(step) * 1.96, 2) AS lower_bound, round(l + t * step + s * sqrt(step) * 1.96, 2) AS upper_bound, CASE WHEN t > 0.01 THEN 'increasing' WHEN t < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend, round(mae, 2) AS mae, n AS periods FROM q, (SELECT l, t FROM f ORDER BY i DESC LIMIT 1), generate_series(1, 6) x(step)"
_FORECASTS = {
    "holt": "f AS (SELECT i, v, v AS l, (SELECT v FROM g WHERE i = 2) - v AS t, v AS fit FROM g WHERE i = 1 UNION ALL SELECT i, v, l, b, l + b FROM (SELECT g.i, g.v, 0.4 * g.v + 0.6 * (f.l + f.t) AS l, 0.2 * (0.4 * g.v + 0.6 * (f.l + f.t) - f.l) + 0.8 * f.t AS b FROM f JOIN g ON g.i = f.i + 1))",
    "ses": "f AS (SELECT i, v, v AS l, CAST(0 AS DOUBLE) AS t, v AS fit FROM g WHERE i = 1 UNION ALL SELECT g.i, g.v, 0.4 * g.v + 0.6 * f.l, CAST(0 AS DOUBLE), 0.4 * g.v + 0.6 * f.l FROM f JOIN g ON g.i = f.i + 1)",
    "moving_average": "f AS (SELECT i, v, avg(v) OVER w AS l, CAST(0 AS DOUBLE) AS t, avg(v) OVER w AS fit FROM g WINDOW w AS (ORDER BY i ROWS 2 PRECEDING))",
}


def _add_forecast(method: str, sql: str) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        return forecast.forecast(orders(spark, sf_dir), "o_orderdate", "month", Metric("sum", "o_totalprice"), method)

    make.__name__ = f"forecast_{method}"
    query_of(_MONTHS + sql + _AHEAD)(make)


for _method, _sql in _FORECASTS.items():
    _add_forecast(_method, _sql)


@query_of()
def kmeans_profiles(spark, sf_dir):
    return segmentation.cluster_profiles(lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount"], 4)


@query_of(places=4)
def pca_points(spark, sf_dir):
    return segmentation.principal_components(orders(spark, sf_dir), ["o_totalprice", "o_custkey", "o_orderkey"])[0]


@query_of("WITH c AS (SELECT corr(o_totalprice, o_custkey) AS a, corr(o_totalprice, o_orderkey) AS b, corr(o_custkey, o_orderkey) AS c FROM orders), p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM c) SELECT round(1 - (1 + 2 * p * cos(acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 + 2 * pi() / 3)) / 3, 4) AS explained FROM p", 4)
def pca_share(spark, sf_dir):
    """What the first two of three components explain: all but the least eigenvalue of the correlation matrix."""
    return spark.createDataFrame([(segmentation.principal_components(orders(spark, sf_dir), ["o_totalprice", "o_custkey", "o_orderkey"])[1],)], "explained double")


@query_of("SELECT CAST(4 AS BIGINT) AS clusters, count(*) AS members, 100.0 AS members_pct, 0.0 AS z_quantity, 0.0 AS z_price, round(avg(l_quantity), 2) AS mean_quantity FROM lineitem")
def kmeans_invariants(spark, sf_dir):
    """What holds for any clustering: all rows are members, and the members' means are the frame's."""
    p = segmentation.cluster_profiles(lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice"], 4)
    mean = lambda c: F.sum(F.col("members") * F.col(c)) / F.sum("members")
    near = lambda c: F.when(F.abs(mean(c)) < 1e-6, F.lit(0.0)).otherwise(mean(c))
    return p.agg(F.count("*").alias("clusters"), F.sum("members").alias("members"), F.sum("members_pct").alias("members_pct"), near("z_l_quantity").alias("z_quantity"), near("z_l_extendedprice").alias("z_price"), mean("mean_l_quantity").alias("mean_quantity"))


@query_of("SELECT label, row_number() OVER (ORDER BY label) AS position FROM (SELECT DISTINCT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label FROM orders) QUALIFY position <= 50")
def period_labels(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(profile.period_labels(orders(spark, sf_dir), "o_orderdate"), 1)), "position bigint, label string")


# profiles and quality

_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "priority", "price")


@query_of(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, count({c}) AS non_null_count, count(DISTINCT {c}) AS distinct_count, round(100.0 * count(DISTINCT {c}) / count({c}), 2) AS distinct_pct FROM {N}" for c in _COLUMNS))
def profile_columns(spark, sf_dir):
    return profile.profile_columns(holed(spark, sf_dir).select(*_COLUMNS))


@query_of(f"WITH t AS (SELECT o_orderstatus, priority FROM {N}) SELECT (SELECT count(*) FROM t) AS row_count, 2 AS column_count, (SELECT count(*) FROM t WHERE priority IS NULL) AS missing_cells, (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_count, round(100.0 * ((SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / (SELECT count(*) FROM t), 2) AS duplicate_pct")
def profile_dataset(spark, sf_dir):
    return profile.profile_dataset(holed(spark, sf_dir).select("o_orderstatus", "priority"))


@query_of(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c}), 2) AS min_value, round(max({c}), 2) AS max_value, round(avg({c}), 2) AS mean_value, round(stddev_samp({c}), 2) AS std_dev, round(sum({c}), 2) AS sum_value, round(quantile_cont({c}, 0.25), 2) AS p25, round(median({c}), 2) AS median_value, round(quantile_cont({c}, 0.75), 2) AS p75 FROM {N}" for c in ("price", "o_totalprice")))
def numeric_stats(spark, sf_dir):
    return profile.numeric_stats(holed(spark, sf_dir), ["price", "o_totalprice"])


@query_of("SELECT value, n, round(100.0 * n / sum(n) OVER (), 2) AS pct, row_number() OVER (ORDER BY n DESC, value) AS rank FROM (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1) ORDER BY rank LIMIT 10")
def top_values(spark, sf_dir):
    return profile.top_values(orders(spark, sf_dir), "o_orderpriority")


@query_of("SELECT 'o_orderdate' AS \"column\", strftime(min(o_orderdate), '%Y-%m-%d') AS min_value, strftime(max(o_orderdate), '%Y-%m-%d') AS max_value, date_diff('day', min(o_orderdate), max(o_orderdate)) AS span_days, count(*) - count(o_orderdate) AS missing_count FROM orders")
def eda_dates(spark, sf_dir):
    return profile.datetime_stats(orders(spark, sf_dir), ["o_orderdate"])


_TEXT = "(SELECT CASE WHEN doc_id % 5 = 0 THEN 'N/A' WHEN doc_id % 5 = 1 THEN ' - ' WHEN doc_id % 5 = 2 THEN CAST(doc_id AS VARCHAR) ELSE lang END AS t FROM documents)"


@query_of(f"SELECT 't' AS \"column\", count(t) AS n, count(*) FILTER (regexp_full_match(trim(t), '[-+]?[0-9]+')) AS numeric_count, count(*) FILTER (lower(trim(t)) IN ('n/a', '-')) AS placeholder_count FROM {_TEXT}")
def quality_text(spark, sf_dir):
    d, i = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id") % 5
    return profile.text_checks(d.select(F.when(i == 0, "N/A").when(i == 1, " - ").when(i == 2, F.col("doc_id").cast("string")).otherwise(F.col("lang")).alias("t")), ["t"])


@query_of("SELECT count(*) AS row_count, count(*) - count(DISTINCT (l_returnflag, l_linestatus, l_discount)) AS duplicate_count, round(100.0 * (count(*) - count(DISTINCT (l_returnflag, l_linestatus, l_discount))) / count(*), 2) AS duplicate_pct FROM lineitem")
def quality_duplicates(spark, sf_dir):
    return profile.duplicate_rows(lineitem(spark, sf_dir).select("l_returnflag", "l_linestatus", "l_discount"))


# cleaning


def _add_clean(name: str, column: str, sql: str, change: Callable[[DataFrame], DataFrame], condition: str = "true") -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        return change(holed(spark, sf_dir)).select("o_orderkey", F.col(column).alias("value"))

    make.__name__ = f"clean_{name}"
    query_of(f"SELECT o_orderkey, {sql} AS value FROM {N} WHERE {condition}")(make)


_add_clean("fill_mean", "price", f"round(coalesce(price, (SELECT avg(price) FROM {N})), 2)", lambda d: cleaning.fill_missing(d, "price", "mean"))
_add_clean("fill_median", "price", f"round(coalesce(price, (SELECT median(price) FROM {N})), 2)", lambda d: cleaning.fill_missing(d, "price", "median"))
_add_clean("fill_mode", "priority", f"coalesce(priority, (SELECT priority FROM {N} WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))", lambda d: cleaning.fill_missing(d, "priority", "mode"))
_add_clean("fill_custom", "priority", "coalesce(priority, 'none')", lambda d: cleaning.fill_missing(d, "priority", "custom", "none"))
_add_clean("ffill", "price", "round(last_value(price IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2)", lambda d: cleaning.fill_missing(d, "price", "forward_fill", order="o_orderkey"))
_add_clean("bfill", "price", "round(first_value(price IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2)", lambda d: cleaning.fill_missing(d, "price", "backward_fill", order="o_orderkey"))
_add_clean("dropna", "price", "round(price, 2)", lambda d: cleaning.drop_missing_rows(d), "price IS NOT NULL AND priority IS NOT NULL")
_add_clean("dedup_subset", "price", "round(price, 2)", lambda d: cleaning.remove_duplicates(d, ["o_custkey", "priority"], "o_orderkey"), f"o_orderkey IN (SELECT min(o_orderkey) FROM {N} GROUP BY o_custkey, priority)")
_add_clean("convert_integer", "price", "CAST(round_even(price, 0) AS BIGINT)", lambda d: cleaning.convert_type(d, "price", "integer"))
_add_clean("convert_float", "priority", "TRY_CAST(substr(priority, 1, 1) AS DOUBLE)", lambda d: cleaning.convert_type(d.withColumn("priority", F.substring("priority", 1, 1)), "priority", "float"))
_add_clean("convert_boolean", "priority", "CASE WHEN substr(priority, 1, 1) = '1' THEN true END", lambda d: cleaning.convert_type(d.withColumn("priority", F.substring("priority", 1, 1)), "priority", "boolean", True))
_add_clean("convert_date", "o_orderdate", "strftime(o_orderdate, '%Y-%m-%d')", lambda d: cleaning.convert_type(d.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), "o_orderdate", "date"))
_IQR = f"(SELECT quantile_cont(price, 0.25) - (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) * 0.5 AS lo, quantile_cont(price, 0.75) + (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) * 0.5 AS hi FROM {N})"
_add_clean("outlier_cap", "price", f"round(CASE WHEN price IS NOT NULL THEN greatest((SELECT lo FROM {_IQR}), least((SELECT hi FROM {_IQR}), price)) END, 2)", lambda d: cleaning.handle_outliers(d, "price", action="cap", threshold=0.5))
_add_clean("outlier_remove", "price", "round(price, 2)", lambda d: cleaning.handle_outliers(d, "price", threshold=0.5), f"price IS NULL OR price BETWEEN (SELECT lo FROM {_IQR}) AND (SELECT hi FROM {_IQR})")
_STEPS = [cleaning.Operation("drop_missing_rows", "priority"), cleaning.Operation("fill_missing", "price", {"strategy": "custom", "value": 0}), cleaning.Operation("rename_column", "price", {"new_name": "amount"}), cleaning.Operation("convert_type", "amount", {"to_type": "integer"}), cleaning.Operation("reorder_columns", None, {"order": ["amount"]})]
_add_clean("pipeline", "amount", "CAST(round_even(coalesce(price, 0), 0) AS BIGINT)", lambda d: cleaning.run_pipeline(d, _STEPS), "priority IS NOT NULL")


# charts


@query_of(f"WITH g AS (SELECT p_brand AS label, sum(revenue) AS v FROM {W} GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY v DESC, label) AS rn FROM g) SELECT row_number() OVER (ORDER BY min(rn)) AS position, CASE WHEN rn > 8 THEN 'Other' ELSE label END AS label, round(sum(v), 2) AS value FROM k GROUP BY 2")
def chart_topn_other(spark, sf_dir):
    return charts.category_chart(wide(spark, sf_dir), "p_brand", "revenue", max_categories=8)


@query_of(f"SELECT r_name AS label, o_orderstatus AS series, round(sum(revenue), 2) AS value FROM {W} GROUP BY 1, 2")
def chart_series(spark, sf_dir):
    return charts.series_chart(wide(spark, sf_dir), "r_name", "o_orderstatus", "revenue")


@query_of("SELECT round(o_totalprice, 2) AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders ORDER BY o_orderkey LIMIT 2000")
def chart_scatter(spark, sf_dir):
    return charts.scatter_chart(orders(spark, sf_dir), "o_totalprice", "o_custkey", "o_orderkey")


# questions and insights


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select(F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("revenue"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("p_brand").alias("brand"), F.col("r_name").alias("region"), F.col("o_orderdate").alias("order_date"))


def kept(df: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The few rows of make(df), with df joined once for all passes of make."""
    with insights.Figures(df) as s:
        out = make(s.df)
        return df.sparkSession.createDataFrame(out.collect(), out.schema)


def _add_question(name: str, text: str, sql: str) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kept(asked(spark, sf_dir), lambda d: questions.ask(d, text)[1])

    make.__name__ = f"nlq_{name}"
    query_of(sql)(make)


_add_question("total", "What is the total revenue?", f"SELECT 'sum_revenue' AS metric, round(sum(revenue), 2) AS value FROM {W}")
_add_question("how_many", "How many records are there?", f"SELECT 'count_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {W}")
_add_question("top5", "Top 5 brand by revenue", f"SELECT p_brand AS label, round(sum(revenue), 2) AS value, round(100 * sum(revenue) / sum(sum(revenue)) OVER (), 2) AS share_pct, count(*) OVER () AS group_count, row_number() OVER (ORDER BY sum(revenue) DESC, p_brand) AS rank FROM {W} GROUP BY 1 ORDER BY rank LIMIT 5")
_add_question("monthly", "Show monthly quantity", f"SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS label, round(sum(l_quantity), 2) AS value FROM {W} GROUP BY 1")

@query_of(f"WITH w AS (SELECT * FROM {W}) SELECT 'records' AS metric, CAST(count(*) AS DOUBLE) AS value FROM w UNION ALL SELECT 'sum_revenue', round(sum(revenue), 2) FROM w UNION ALL SELECT 'average_revenue', round(avg(revenue), 2) FROM w UNION ALL SELECT 'sum_quantity', round(sum(l_quantity), 2) FROM w UNION ALL SELECT 'average_quantity', round(avg(l_quantity), 2) FROM w UNION ALL SELECT 'average_discount', round(avg(l_discount), 2) FROM w UNION ALL SELECT 'unique_customer_id', count(DISTINCT o_custkey) FROM w UNION ALL SELECT 'unique_order_id', count(DISTINCT l_orderkey) FROM w UNION ALL SELECT 'unique_brand', count(DISTINCT p_brand) FROM w UNION ALL SELECT 'revenue_per_order_id', round(sum(revenue) / count(DISTINCT l_orderkey), 2) FROM w")
def insight_kpis(spark, sf_dir):
    return kept(asked(spark, sf_dir), lambda d: insights.headline_kpis(d, questions.semantic_model(d)))


_MOVED = "(last_value - first_value) / first_value * 100"


@query_of(
    f"WITH w AS (SELECT revenue, l_quantity, l_discount, date_trunc('quarter', o_orderdate) AS b FROM {W}), s AS (SELECT 'revenue' AS name, b, sum(revenue) AS v FROM w GROUP BY b UNION ALL SELECT 'quantity', b, sum(l_quantity) FROM w GROUP BY b UNION ALL SELECT 'discount', b, avg(l_discount) FROM w GROUP BY b),"
    " e AS (SELECT name, count(*) AS periods, arg_min(v, b) AS first_value, arg_max(v, b) AS last_value, arg_max(b, v) AS pb, max(v) AS pv, arg_min(b, v) AS tb, min(v) AS tv FROM s GROUP BY name)"
    f" SELECT name, periods, round(first_value, 2) AS first_value, round(last_value, 2) AS last_value, round({_MOVED}, 2) AS change_pct, CASE WHEN periods < 3 THEN 'insufficient_data' WHEN {_MOVED} > 5 THEN 'increasing' WHEN {_MOVED} < -5 THEN 'decreasing' ELSE 'stable' END AS direction,"
    " year(pb) || '-Q' || quarter(pb) AS peak_label, round(pv, 2) AS peak_value, year(tb) || '-Q' || quarter(tb) AS trough_label, round(tv, 2) AS trough_value FROM e"
)
def insight_trends(spark, sf_dir):
    return kept(asked(spark, sf_dir), lambda d: insights.headline_trends(d, questions.semantic_model(d)))


@query_of()
def insight_findings(spark, sf_dir):
    rows = [(f.id, f.severity, f.priority, f.score, f.title) for f in insights.detect_all(asked(spark, sf_dir)).findings]
    return spark.createDataFrame(rows, "id string, severity string, priority string, score double, title string")


_BAND = "CASE WHEN c >= 20 THEN 100.0 WHEN c >= 5 THEN 80.0 WHEN c >= -5 THEN 60.0 WHEN c >= -20 THEN 35.0 ELSE 10.0 END"


@query_of(
    f"WITH w AS (SELECT o_custkey, revenue, l_quantity, l_discount, o_orderdate, date_trunc('quarter', o_orderdate) AS b FROM {W}), q AS (SELECT b, count(*) AS n, sum(revenue) AS v, count(DISTINCT o_custkey) AS k FROM w GROUP BY b),"
    " t AS (SELECT 'order_trend' AS factor, 0.15 AS weight, (arg_max(n, b) - arg_min(n, b)) * 100.0 / arg_min(n, b) AS c FROM q UNION ALL SELECT 'revenue_trend', 0.25, (arg_max(v, b) - arg_min(v, b)) * 100.0 / arg_min(v, b) FROM q UNION ALL SELECT 'customer_trend', 0.15, (arg_max(k, b) - arg_min(k, b)) * 100.0 / arg_min(k, b) FROM q),"
    " l AS (SELECT o_custkey, max(o_orderdate) AS t FROM w GROUP BY 1), z AS (SELECT 100.0 * count(*) FILTER (date_diff('second', t, (SELECT max(t) FROM l)) >= 90 * 86400) / count(*) AS rate FROM l),"
    " v AS (SELECT 1 AS i, revenue AS x FROM w UNION ALL SELECT 2, l_quantity FROM w UNION ALL SELECT 3, l_discount FROM w), p AS (SELECT i, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY i),"
    " a AS (SELECT max(pct) AS most FROM (SELECT 100.0 * count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / count(*) AS pct FROM v JOIN p USING (i) WHERE q3 > q1 GROUP BY i)),"
    f" f AS (SELECT factor, {_BAND} AS score, weight FROM t UNION ALL SELECT 'churn', greatest(0.0, least(100.0, 100 - 2 * rate)), 0.15 FROM z UNION ALL SELECT 'anomalies', greatest(0.0, least(100.0, 100 - 10 * most)), 0.10 FROM a),"
    " s AS (SELECT factor, CAST(score AS DOUBLE) AS score, CAST(weight / sum(weight) OVER () AS DOUBLE) AS weight FROM f)"
    " SELECT factor, round(score, 2) AS score, round(round(weight, 4), 2) AS weight FROM s UNION ALL SELECT 'overall', round(sum(score * weight)), 1.0 FROM s"
)
def health_score(spark, sf_dir):
    h = insights.health(asked(spark, sf_dir))
    return spark.createDataFrame([("overall", float(h["score"]), 1.0), *((f["factor"], float(f["score"]), float(f["weight"])) for f in h["factors"])], "factor string, score double, weight double")


_ASKED = f"(SELECT revenue, l_quantity AS quantity, l_discount AS discount, p_brand AS label, o_orderdate AS day FROM {W})"
_FAR = (
    f"WITH a AS (SELECT * REPLACE (revenue * revenue * revenue / 1e9 AS revenue) FROM {_ASKED}), l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v, label, day FROM a" for c in ("revenue", "quantity", "discount")) + "),"
    ' q AS (SELECT "column", count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q WHERE q3 > q1),'
    ' o AS (SELECT l.*, n, lo, hi, greatest(lo - v, v - hi) AS far FROM l JOIN f USING ("column") WHERE v < lo OR v > hi)'
)


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asked() with a measure that has outliers."""
    return asked(spark, sf_dir).withColumn("revenue", F.col("revenue") * F.col("revenue") * F.col("revenue") / 1e9)


@query_of(f"""{_FAR}, g AS (SELECT "column", label, count(*) AS k, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM o GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY "column") AS outliers, row_number() OVER (PARTITION BY "column" ORDER BY k DESC, label) AS rank FROM g)
SELECT "column", n, CAST(outliers AS BIGINT) AS outliers, round(100.0 * outliers / n, 2) AS outlier_pct, round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound, rank, label, CAST(k AS DOUBLE) AS value, round(100.0 * k / outliers, 2) AS share_pct FROM r WHERE rank <= 3""")
def anomaly_groups(spark, sf_dir):
    """The groups that most outliers of each measure are in."""
    with insights.Figures(skewed(spark, sf_dir)) as s:  # joined once for all passes
        found = s.anomalies
    rows = [(a["column"], a["n"], a["outliers"], a["outlier_pct"], a["lower_bound"], a["upper_bound"], g["rank"], g["label"], g["value"], g["share_pct"]) for a in found for g in a.get("groups", ())]
    return spark.createDataFrame(rows, "`column` string, n bigint, outliers bigint, outlier_pct double, lower_bound double, upper_bound double, rank bigint, label string, value double, share_pct double")


@query_of(f"""{_FAR} SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY far DESC, v DESC, label, day) AS rank, round(v, 2) AS value, label, strftime(day, '%Y-%m-%d %H:%M:%S') AS day FROM o QUALIFY rank <= 5""")
def anomaly_examples(spark, sf_dir):
    """The five rows of each measure that lie farthest beyond its fences."""
    with insights.Figures(skewed(spark, sf_dir)) as s:
        found = s.anomalies
    rows = [(a["column"], k, x["value"], x["label"], x["date"]) for a in found for k, x in enumerate(a.get("examples", ()), 1)]
    return spark.createDataFrame(rows, "`column` string, rank bigint, value double, label string, day string")


@query_of(" UNION ALL ".join(f"SELECT '{a}-{b}' AS roles, '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 4) AS r, count(*) AS n FROM {_ASKED}" for a, b in (("revenue", "discount"), ("revenue", "quantity"), ("quantity", "discount"))), 4)
def insight_relationships(spark, sf_dir):
    """The pairs of measures that relationship findings look at, all in one pass."""
    with insights.Figures(asked(spark, sf_dir)) as s:
        rows = [(roles, a, b, s.base[f"r{i}"], s.base[f"both{i}"]) for i, (roles, a, b, _) in enumerate(s.pairs)]
    return spark.createDataFrame(rows, "roles string, left_column string, right_column string, r double, n bigint")


@query_of(f"SELECT unnest([1, 1]) AS version, unnest([n, n]) AS analysed, unnest(['before', 'after']) AS moment, unnest([false, true]) AS stale FROM (SELECT count(*) AS n FROM {W})")
def insight_runs(spark, sf_dir):
    """A run on a version, read back as it is, and again when the dataset has moved on."""
    versions = Versions(spark, f"{shared_dir(spark)}/runs/{uuid.uuid4().hex}")
    versions.add(asked(spark, sf_dir), [])
    kept = runs.InsightRuns(versions)
    kept.generate()
    before = kept.latest()
    versions.add(versions.read(1).where("quantity > 10"), [], 1)
    found = [("before", before), ("after", kept.latest())]
    return spark.createDataFrame([(r["version"], r["result"]["overview"]["rows"], moment, r["stale"]) for moment, r in found], "version bigint, analysed bigint, moment string, stale boolean")


@query_of(f"SELECT coalesce(priority, '(empty)') AS label, round(median(price) / avg(price), 4) AS value FROM {N} WHERE price > 20000 GROUP BY 1", 4)
def kpi_median_ratio(spark, sf_dir):
    """A formula with a median by group."""
    ratio = Binary("/", Metric("median", "price"), Metric("average", "price"))
    return query.kpi_groups(holed(spark, sf_dir), Kpi("middle", formula=ratio, filters=where(Condition("price", "greater_than", 20000)), group_by="priority"))


@query_of(f"""WITH a AS (SELECT count(*) AS n, count_if(priority IS NULL) AS priority, count_if(price IS NULL) AS price FROM {N}), l AS (UNPIVOT a ON priority, price INTO NAME "column" VALUE rows)
SELECT 'missing_values' AS kind, CASE WHEN 100.0 * rows / n > 5 THEN 'warning' ELSE 'info' END AS severity, "column", rows, round(100.0 * rows / n, 2) AS pct FROM l WHERE rows > 0""")
def quality_rules(spark, sf_dir):
    """What the quality rules say of a frame with two incomplete columns, with severities."""
    d = holed(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "priority", "price")
    return spark.createDataFrame([(x["kind"], x["severity"], x["column"], x["rows"], x["pct"]) for x in profile.quality_issues(d)], "kind string, severity string, `column` string, rows bigint, pct double")


_ROLE = "SELECT '{c}' AS \"column\", '{t}' AS type, {d} AS distinct_values, {d} > 1 AND {i} AS identifier, {d} BETWEEN 1 AND 1000 AND NOT ({d} > 1 AND {i}) AS categorical FROM orders"


@query_of(" UNION ALL ".join(_ROLE.format(c=c, t="string", d=f"count(DISTINCT {c})", i=f"(count(DISTINCT {c}) > 1000 OR count(DISTINCT {c}) > 0.9 * count(*))") for c in ("o_orderstatus", "o_orderpriority", "word_free", "clerk")).replace("FROM orders", "FROM (SELECT *, 'x' || CAST(o_custkey AS VARCHAR) AS word_free, 'c' || CAST(o_custkey % 900 AS VARCHAR) AS clerk FROM orders)"))
def column_roles(spark, sf_dir):
    """What text columns can be used for, from one read of them all."""
    d = orders(spark, sf_dir).select("o_orderstatus", "o_orderpriority", F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("word_free"), F.concat(F.lit("c"), (F.col("o_custkey") % 900).cast("string")).alias("clerk"))
    rows = [(c["column"], c["type"], c["distinct"], c["identifier"], c["categorical"]) for c in profile.describe_columns(d)]
    return spark.createDataFrame(rows, "`column` string, type string, distinct_values bigint, identifier boolean, categorical boolean")


# what cleaning did, versions, datasets

_CLEANED = f"""WITH a AS (SELECT o_orderkey, o_custkey, priority, price, o_orderstatus FROM {N}),
m AS (SELECT median(price) AS m FROM a), b AS (SELECT o_orderkey, o_custkey, priority, coalesce(price, m) AS price, o_orderstatus FROM a, m),
c AS (SELECT * FROM b WHERE priority IS NOT NULL), d AS (SELECT o_custkey, o_orderstatus, min_by(price, o_orderkey) AS price, min(o_orderkey) AS o_orderkey FROM c GROUP BY ALL),
q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM d),
n AS (SELECT (SELECT count(*) FROM a WHERE price IS NULL) AS f0, (SELECT count(*) FROM b) - (SELECT count(*) FROM c) AS f1, (SELECT count(*) FROM c) - (SELECT count(*) FROM d) AS f2,
    (SELECT count(*) FROM d, q WHERE price < q1 - 0.5 * (q3 - q1) OR price > q3 + 0.5 * (q3 - q1)) AS f3, (SELECT count(*) FROM d WHERE o_orderstatus IS NOT NULL) AS f4)"""
_TRACKED = [
    cleaning.Operation("fill_missing", "price", {"strategy": "median"}),
    cleaning.Operation("drop_missing_rows", "priority"),
    cleaning.Operation("remove_duplicates", None, {"subset": ["o_custkey", "o_orderstatus"]}),
    cleaning.Operation("handle_outliers", "price", {"action": "cap", "threshold": 0.5}),
    cleaning.Operation("convert_type", "o_orderstatus", {"to_type": "integer", "errors_to_null": True}),
]


@query_of(
    _CLEANED
    + " SELECT unnest(range(5)) AS index, unnest(['fill_missing', 'drop_missing_rows', 'remove_duplicates', 'handle_outliers', 'convert_type']) AS operation, unnest(['price', 'priority', NULL, 'price', 'o_orderstatus']) AS \"column\","
    + " unnest([f0, f1, f2, f3, f4]) AS rows_affected, unnest([NULL, NULL, NULL, NULL, f4 || ' values of ''o_orderstatus'' could not be converted and are now empty']) AS warning FROM n"
)
def clean_outcomes(spark, sf_dir):
    """A row for each operation: what it did to how many rows or cells."""
    d = holed(spark, sf_dir).select("o_orderkey", "o_custkey", "priority", "price", "o_orderstatus")
    done = cleaning.run_tracked(d, _TRACKED, "o_orderkey")[1]
    return spark.createDataFrame([(o.index, o.operation, o.column, o.rows_affected, o.warning) for o in done], "index bigint, operation string, `column` string, rows_affected bigint, warning string")


@query_of(f"SELECT unnest([1, 2, 3]) AS version, unnest([0, 1, 2]) AS source, unnest([n, m, m]) AS rows_held FROM (SELECT (SELECT count(*) FROM {N}) AS n, (SELECT count(*) FROM {N} WHERE priority IS NOT NULL) AS m)")
def dataset_versions(spark, sf_dir):
    """An upload, a version of it, one cleaned from that, and one from the latest: their lineage and rows, read back by name."""
    root = f"{shared_dir(spark)}/datasets/{uuid.uuid4().hex}"
    known = Datasets(spark, root)
    known.register("orders", f"{sf_dir}/orders.parquet")
    held = known.versions("orders")
    held.add(known.resolve("orders")[0].join(holed(spark, sf_dir).select("o_orderkey", "priority", "price"), "o_orderkey"), [])
    cleaning.apply_as_version(held, [cleaning.Operation("drop_missing_rows", "priority")])
    cleaning.apply_as_version(held, [cleaning.Operation("rename_column", "price", {"new_name": "amount"})])
    rows = [(r["version"], r["source"] or 0, known.resolve("orders", r["version"])[0].count()) for r in held.list()]
    return spark.createDataFrame(rows, "version bigint, source bigint, rows_held bigint")
