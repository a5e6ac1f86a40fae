"""Operators on small frames: fixed expectations, invariants, and pandas as a second opinion."""

import datetime as dt
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeglass.functions.stats import bin_of, quintile
from lakeglass.operators import charts, cleaning, customers, distribution, forecast, insights, profile, query, questions, ranking, reports, segmentation, timeseries
from lakeglass.plans.compile import apply_filters
from lakeglass.plans.requests import Aggregate, Binary, Condition, Constant, FilterSet, Kpi, Metric, Query, RequestError
from lakeglass.sources import storage
from lakeglass.streaming import windows


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(i + 1, 1000 + i % 40, round(10.5 + 1.37 * i, 2), i % 5 + 1, "North", ("Electronics", "Grocery", "Apparel")[i % 3], dt.datetime(2026, 1, 1) + dt.timedelta(days=i)) for i in range(200)]
    return spark.createDataFrame(rows, "order_id bigint, customer_id bigint, revenue double, quantity bigint, region string, category string, order_date timestamp").cache()


def one(df):
    return df.first().asDict()


def test_roles(sales):
    roles = {c["column"]: c for c in profile.describe_columns(sales)}
    assert roles["order_id"]["identifier"] and roles["customer_id"]["identifier"]
    assert roles["revenue"]["measure"] and roles["quantity"]["measure"]
    assert roles["category"]["categorical"] and roles["order_date"]["temporal"]
    assert charts.suggest_charts(list(roles.values()))[0]["kind"] == "line"


def test_metrics_and_formulas(spark):
    m = lambda d, x: query.metrics(d, {"x": x}).first()["value"]
    single = spark.createDataFrame([(5.0, 0.0)], "value double, zero double")
    assert m(single, Metric("std_dev", "value")) is None
    assert m(single, Binary("/", Metric("sum", "value"), Metric("sum", "zero"))) is None
    holed = spark.createDataFrame([(10.0,), (None,), (20.0,)], "value double")
    assert (m(holed, Metric("sum", "value")), m(holed, Metric("average", "value")), m(holed, Metric("count", "value"))) == (30.0, 15.0, 2.0)
    assert m(holed.where("false"), Metric("sum", "value")) is None
    deep = Constant(1)
    for _ in range(10):
        deep = Binary("+", deep, Constant(1))
    with pytest.raises(RequestError):
        m(holed, deep)
    with pytest.raises(RequestError):
        m(spark.createDataFrame([("a",)], "value string"), Metric("sum", "value"))


def test_filters(spark):
    d = spark.createDataFrame([(1, "Anna", 1.0), (2, None, float("nan")), (3, "bob", None)], "k int, name string, v double")
    keys = lambda *c, combine="and": {r.k for r in apply_filters(d, FilterSet(c, combine)).collect()}
    assert keys(Condition("name", "not_equals", "bob")) == {1, 2}
    assert keys(Condition("name", "contains", "AN")) == {1}
    assert keys(Condition("v", "is_null")) == {2, 3}
    assert keys(Condition("v", "equals", 1)) == {1}
    assert keys(Condition("k", "between", 3, 2)) == {2, 3}
    assert keys(Condition("k", "equals", 1), Condition("name", "equals", "bob"), combine="or") == {1, 3}
    for bad in (Condition("nope", "is_null"), Condition("name", "greater_than", 1)):
        with pytest.raises(RequestError):
            keys(bad)


def test_query(sales):
    rows = query.run_query(sales, Query(group_by=("category",), aggregations=(Aggregate("sum", "revenue"), Aggregate("max", "order_date", "last")), sort_by="sum_revenue", sort_desc=True, limit=2)).collect()
    assert len(rows) == 2 and rows[0].sum_revenue >= rows[1].sum_revenue and isinstance(rows[0]["last"], dt.datetime)
    assert [r.order_id for r in query.preview(sales, 2, 5, "order_id").collect()] == [6, 7, 8, 9, 10]


def test_time_series(sales):
    rows = timeseries.time_series(sales, "order_date", "month", Metric("sum", "revenue")).orderBy("bucket").collect()
    assert len(rows) == 7 and rows[0].label == "2026-01"
    gap = timeseries.time_series(sales.where("month(order_date) IN (1, 4)"), "order_date", "month", Metric("count")).orderBy("bucket").collect()
    assert [r.value for r in gap] == [31.0, 0.0, 0.0, 30.0]
    assert {r.label for r in timeseries.time_series(sales, "order_date", "week", Metric("count")).collect()} >= {"2026-W01", "2026-W02"}
    assert timeseries.growth(sales, "order_date", "month", Metric("count")).orderBy("bucket").first().previous_value is None


def test_ranking(sales):
    rows = ranking.segment(sales, "category", Metric("sum", "revenue")).collect()
    assert len(rows) == 3 and abs(sum(r.share_pct for r in rows) - 100) < 1e-9
    assert ranking.contribution(sales, "customer_id", Metric("sum", "revenue")).orderBy(F.desc("rank")).first().cumulative_pct == pytest.approx(100)
    assert [r["class"] for r in ranking.abc_summary(ranking.abc(sales, "region", Metric("sum", "revenue"))).orderBy("class").collect()] == ["A", "B", "C"]
    assert ranking.abc(sales, "region", Metric("sum", "revenue")).first()["class"] == "C"
    assert ranking.pareto(sales, "region", Metric("sum", "revenue")).first().vital_few
    assert one(ranking.entity_summary(sales, "customer_id", "revenue"))["entities"] == 40
    assert ranking.entity_top(sales, "customer_id", "revenue", limit=3).count() == 3


@pytest.mark.parametrize("values", [[1.0, 1.0, 2.0, 3.0, 10.0], list(np.random.default_rng(1).normal(size=200)), [7.0] * 4])
def test_histogram(spark, values):
    d = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r.n for r in distribution.histogram(d, "v", 5).orderBy("bin").collect()]
    if len(set(values)) > 1:
        assert got == pd.cut(pd.Series(values), 5).value_counts(sort=False).tolist()
    assert sum(got) == len(values)


def test_expressions(spark):
    for n in (10, 12, 13, 17, 23, 100):
        got = [r.q for r in spark.range(1, n + 1).select(quintile(F.col("id"), F.lit(n)).alias("q")).collect()]
        assert got == pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert spark.range(1).select(bin_of(F.lit(1.0), F.lit(1.0), F.lit(1.0), 4).alias("b")).first().b == 1


def test_distribution(sales, spark):
    s = one(distribution.distribution_stats(sales, "revenue"))
    assert s["n"] == 200 and s["p50"] == s["median_value"]
    assert one(distribution.outliers(spark.createDataFrame([(1.0,)] * 5, "v double"), "v"))["outliers"] == 0
    r = distribution.correlation_matrix(sales.withColumn("flat", F.lit(1.0)), ["revenue", "quantity", "flat"]).collect()
    assert [(x.left_column, x.right_column) for x in r] == [("revenue", "quantity")]
    assert one(distribution.correlation_exclusions(sales.withColumn("flat", F.lit(1.0)), ["revenue", "flat"]))["reason"] == "constant"


def test_customers(sales, spark):
    scored = customers.rfm(sales, "customer_id", "order_date", "revenue")
    assert scored.count() == 40 and {r.r_score for r in scored.collect()} == {1, 2, 3, 4, 5}
    assert abs(sum(r.customers_pct for r in customers.rfm_segments(scored).collect()) - 100) < 1e-9
    with pytest.raises(RequestError):
        customers.rfm(sales.limit(5), "customer_id", "order_date", "revenue")
    order = [F.col("revenue"), F.col("order_id")]
    assert [r.pos for r in customers.ranked(sales.select("revenue", "order_id"), order, "pos").orderBy("revenue").collect()] == list(range(1, 201))
    cells = customers.cohort_matrix(sales, "customer_id", "order_date")
    assert cells.where("period_offset = 0").agg(F.sum("customers")).first()[0] == 40
    s = one(customers.churn_summary(customers.churn_customers(sales, "customer_id", "order_date", "revenue")))
    assert s["customers"] == s["active_customers"] + s["at_risk_customers"] + s["churned_customers"] == 40
    assert customers.churn_trend(sales, "customer_id", "order_date").count() == 7
    assert customers.most_inactive(customers.churn_customers(sales, "customer_id", "order_date")).count() == 0


@pytest.mark.parametrize("method", forecast.METHODS)
def test_forecast(sales, method):
    rows = forecast.forecast(sales, "order_date", "month", Metric("sum", "revenue"), method, 4).orderBy("step").collect()
    assert len(rows) == 4 and all(r.lower_bound <= r.value <= r.upper_bound for r in rows)
    assert forecast.forecast(sales.limit(20), "order_date", "month", Metric("count"), method).count() == 0


def test_segmentation(sales):
    rows = segmentation.cluster_profiles(sales, ["revenue", "quantity"], 3).collect()
    assert sum(r.members for r in rows) == 200 and len(rows) == 3
    points, explained = segmentation.principal_components(sales, ["revenue", "quantity"])
    assert points.count() == 200 and 0.99 < explained <= 1.0001


def test_profile_and_quality(spark):
    d = spark.createDataFrame([("1", None, "a", "x"), ("2", None, "a", "N/A"), ("3", None, "a", "y"), ("3", None, "a", "y")], "num string, empty string, flat string, t string")
    p = {r.column: r for r in profile.profile_columns(d).collect()}
    assert p["empty"].null_pct == 100 and p["num"].distinct_count == 3
    assert one(profile.profile_dataset(d))["duplicate_count"] == 1
    kinds = {(x["kind"], x["column"]) for x in profile.quality_issues(d)}
    assert {("empty_column", "empty"), ("constant_column", "flat"), ("possible_wrong_type", "num"), ("suspicious_values", "t"), ("duplicate_rows", None)} <= kinds
    score, status = profile.quality_score(profile.quality_issues(d))
    assert status == "critical" and 0 <= score < 100
    dates = spark.createDataFrame([(f"2024-01-0{i}",) for i in range(1, 8)], "d string")
    assert profile.detect_types(dates) == {"d": "datetime"}
    assert profile.eda_summary(dates)["datetime"][0]["span_days"] == 6
    assert profile.filter_options(d)["flat"]["values"] == ["a"]


def test_cleaning(spark, tmp_path):
    d = spark.createDataFrame([(1, 1.0, "yes"), (2, None, "no"), (3, 3.0, None), (4, None, "5d"), (5, 2.5, "yes")], "k int, v double, t string")
    col = lambda x, c: [r[c] for r in x.orderBy("k").collect()]
    assert col(cleaning.fill_missing(d, "v", "forward_fill", order="k"), "v") == [1.0, 1.0, 3.0, 3.0, 2.5]
    assert col(cleaning.fill_missing(d, "v", "backward_fill", order="k"), "v") == [1.0, 3.0, 3.0, 2.5, 2.5]
    assert col(cleaning.fill_missing(d, "v", "median"), "v") == [1.0, 2.5, 3.0, 2.5, 2.5]
    assert col(cleaning.fill_missing(d, "t", "mode"), "t")[2] == "yes"
    assert col(cleaning.convert_type(d, "v", "integer"), "v") == [1, None, 3, None, 2]
    assert col(cleaning.convert_type(d, "t", "boolean", True), "t") == [True, False, None, None, True]
    with pytest.raises(RequestError):
        cleaning.convert_type(d, "t", "float")
    assert cleaning.remove_duplicates(d, ["t"], "k").count() == 4
    assert col(cleaning.handle_outliers(spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "k int, v double"), "v", action="cap"), "v")[-1] == 7.0
    steps = [cleaning.Operation("fill_missing", "v", {"strategy": "mean"}), cleaning.Operation("drop_missing_rows", "t"), cleaning.Operation("rename_column", "t", {"new_name": "answer"})]
    steps = cleaning.from_manifest(json.loads(json.dumps(cleaning.as_manifest(steps))))
    out = cleaning.run_pipeline(d, steps, "k")
    assert out.columns == ["k", "v", "answer"] and out.count() == 4
    assert cleaning.preview(d, out)["dropped"] == ["t"]
    versions = storage.Versions(spark, f"file://{tmp_path}/data")
    assert versions.list() == [] and versions.add(d, []) == 1 and versions.add(out, cleaning.as_manifest(steps), 1) == 2
    assert versions.read(1).count() == 5 and versions.read().columns == out.columns and versions.list()[1]["source"] == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("order_id;region;amount\n1;Süd;1,5\n2;N/A;2\n3;;3\n".encode("cp1252"))
    d = storage.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert d.columns == ["order_id", "region", "amount"] and [r.region for r in d.orderBy("order_id").collect()] == ["Süd", None, None]
    assert storage.metadata(d)["row_count"] == 3 and dict(d.dtypes)["order_id"] == "bigint"
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="B1" t="inlineStr"><is><t>v</t></is></c></row><row><c r="A2"><v>1</v></c><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert storage.read_xlsx(spark, f"file://{tmp_path}/a.xlsx").collect()[0].asDict() == {"k": 1, "v": 2.5}
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    with pytest.raises(RequestError):
        storage.read_xlsx(spark, f"file://{tmp_path}/b.xlsx")


def test_charts(sales):
    rows = charts.category_chart(sales, "customer_id", "revenue", max_categories=5).orderBy("position").collect()
    assert len(rows) == 6 and rows[-1].label == "Other"
    assert charts.pivot_chart(sales, "region", "category", "revenue").count() == 1
    for kind in charts.CHARTS:
        assert charts.chart(sales, kind, "revenue" if kind in ("scatter", "histogram") else "category", "quantity", order="order_id").count()


def test_questions(sales):
    answer, rows = questions.ask(sales, "What is total revenue?")
    assert answer.plan.intent == "metric" and rows.first().value == pytest.approx(sales.agg(F.sum("revenue")).first()[0])
    assert questions.ask(sales, "top 2 category by revenue")[1].count() == 2
    assert questions.ask(sales, "monthly revenue")[1].count() == 7
    assert questions.ask(sales, "how many orders are there")[1].first().value == 200
    found = [r.asDict() for r in rows.collect()]
    assert questions.untraceable(questions.answer_text(answer.plan, found), found) == [] and questions.untraceable("about 12345", found) == ["12345"]
    assert questions.ask(sales.select("category"), "total")[0].clarification


def test_insights_and_reports(sales):
    model = questions.semantic_model(sales)
    r = insights.detect_all(sales, model)
    assert r.findings == sorted(r.findings, key=lambda f: (-f.score, f.id)) and "operations" in r.skipped
    h = insights.health(sales, model)
    assert 0 <= h["score"] <= 100 and abs(sum(f["weight"] for f in h["factors"]) - 1) < 0.01
    assert insights.priority("critical", 60, 1.0)[0] == "critical" and insights.priority("info")[0] == "low"
    report = reports.build_report(sales, ["overview", "kpis", "abc", "churn", "correlation"])
    assert set(report["sections"]) == {"overview", "kpis", "abc", "churn", "correlation"} and report["skipped"] == {}
    assert "<table>" in reports.render_html(report) and "overview" in reports.render_csv(report) and json.loads(reports.render_json(report))
    out = reports.refresh(sales, [reports.Widget("kpi", "Rows"), reports.Widget("table", "T", {"columns": ["nope"]}), reports.Widget("text", "N", {"text": "x"})])
    assert out[0]["data"][0]["value"] == 200 and "error" in out[1] and out[2]["data"] == "x"
    assert reports.dashboard_template("sales", model) and reports.capabilities(model)["rfm"] is None


def test_streaming(spark, tmp_path):
    rows = [(f"u{i % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1.0) for i in range(48)]
    spark.createDataFrame(rows, "user string, ts timestamp, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    q = windows.windowed_series(stream, "ts", "day", "value").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("w").collect()) == [24, 24]
    assert windows.sessions(spark.read.parquet(f"{tmp_path}/in"), "user", "ts", "4 hours").count() == 3


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "seg_share" in e.queries()


@pytest.mark.parametrize(
    "column, op, value, pushed",
    [
        ("k", "equals", 3, "EqualTo(k,3)"),
        ("k", "not_equals", 3, "EqualNullSafe(k,3)"),
        ("k", "greater_than", 2.5, "GreaterThan(k,2)"),
        ("k", "less_or_equal", 7, "LessThanOrEqual(k,7)"),
        ("v", "greater_or_equal", 1.5, "GreaterThanOrEqual(v,1.5)"),
        ("s", "equals", "x", "EqualTo(s,x)"),
        ("d", "less_than", "2024-03-01", "LessThan(d,"),
        ("k", "is_null", None, "IsNull(k)"),
    ],
)
def test_filters_reach_the_scan(spark, tmp_path, column, op, value, pushed):
    d = spark.createDataFrame([(1, 1.0, "x", dt.datetime(2024, 1, 1)), (None, None, None, None)], "k bigint, v double, s string, d timestamp")
    d.write.parquet(f"{tmp_path}/t")
    found = apply_filters(spark.read.parquet(f"{tmp_path}/t"), FilterSet((Condition(column, op, value),), "and"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters")[1]


def test_filters_of_fractions_and_nan(spark):
    d = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 5.0), (None, None)], "k int, v double")
    keys = lambda c, o, x, y=None: {r.k for r in apply_filters(d, FilterSet((Condition(c, o, x, y),), "and")).collect()}
    assert keys("k", "greater_than", 1.5) == {2, 3} and keys("k", "less_than", 2.5) == {1, 2} and keys("k", "greater_or_equal", 2.5) == {3} and keys("k", "less_or_equal", 2.5) == {1, 2}
    assert keys("k", "equals", 2.5) == set() and keys("k", "not_equals", 2.5) == {1, 2, 3, None} and keys("k", "between", 3, 1.5) == {2, 3}
    assert keys("v", "greater_than", 0) == {1, 3} and keys("v", "between", 0, 9) == {1, 3} and keys("k", "equals", "abc") == set()


def test_kpis_that_are_not_available(spark):
    d = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b"), (3, None, "b")], "k int, v double, g string")
    some = FilterSet((Condition("g", "equals", "a"), Condition("k", "equals", 2)), "or")
    wanted = [Kpi("sum", Metric("sum", "v")), Kpi("or", Metric("sum", "v", some), filters=FilterSet((Condition("k", "greater_than", 1),))), Kpi("unknown", Metric("sum", "x")), Kpi("text", Metric("sum", "g")), Kpi("none", Metric("sum", "v"), filters=FilterSet((Condition("k", "equals", 3),)))]
    got = {r.kpi: (r.value, r.available) for r in query.evaluate_kpis(d, wanted).collect()}
    assert got == {"sum": (5.0, True), "or": (3.0, True), "unknown": (None, False), "text": (None, False), "none": (None, False)}
    assert all(r.reason for r in query.evaluate_kpis(d, wanted).collect() if not r.available)


def test_null_ordinals(spark):
    d = spark.createDataFrame([("a", None, 1.0), ("a", None, None), ("b", 2, 5.0), ("b", 1, 6.0), ("b", None, 7.0)], "g string, o int, v double")
    assert {(r.g, r.v) for r in cleaning.remove_duplicates(d, ["g"], "o").collect()} in ({("a", 1.0), ("b", 6.0)}, {("a", None), ("b", 6.0)})
    e = spark.createDataFrame([(1, 4.0), (2, None), (None, None)], "o int, v double")
    assert sorted(repr(r.v) for r in cleaning.carry(e, "v", "o").collect()) == ["4.0", "4.0", "4.0"]


def test_columns_named_like_helpers(spark):
    d = spark.createDataFrame([(i, float(i) if i else None, 9.0, 8.0, 7.0) for i in range(10)], "o int, v double, fill double, lo double, part double")
    assert cleaning.fill_missing(d, "v", "mean").where("v IS NULL").count() == 0
    assert cleaning.handle_outliers(d, "v", action="cap").columns == d.columns and distribution.outlier_rows(d, "v").columns == d.columns
    assert cleaning.carry(d, "v", "o", False).agg(F.sum("part")).first()[0] == 70.0


def test_quoted_newline_after_the_head(spark, tmp_path):
    rows = [f"{i},plain text of a row" for i in range(4000)] + ['4000,"two\nlines"']
    (tmp_path / "t.csv").write_text("k,t\n" + "\n".join(rows) + "\n")
    assert storage.read_csv(spark, f"file://{tmp_path}/t.csv").count() == 4001


def test_no_task_gets_all_groups(spark):
    d = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 1.5 + 1).alias("v"))
    for f in (lambda: ranking.segment(d, "k", Metric("sum", "v")), lambda: ranking.contribution(d, "k", Metric("sum", "v")), lambda: ranking.abc(d, "k", Metric("sum", "v"))):
        plan = f()._jdf.queryExecution().executedPlan().toString()
        before_limit = plan.split("TakeOrderedAndProject")[-1]
        assert "Window" not in before_limit or "hashpartitioning(part" in before_limit
    got = ranking.abc(d, "k", Metric("sum", "v")).toPandas().sort_values("rank")
    want = pd.Series(np.arange(1000) * 1.5 + 1).sort_values(ascending=False)
    assert got["rank"].tolist() == list(range(1, 1001)) and np.allclose(got["cumulative_pct"], want.cumsum() / want.sum() * 100, atol=1e-3)
