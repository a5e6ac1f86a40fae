"""What a review found on odd inputs and larger tables."""

from pyspark.sql import functions as F

from lakeglass.operators import cleaning, profile


def test_backward_fill_reads_no_frame_anew(spark):
    """A frame that ends with its range would cost each row a pass over the range."""
    rows = [(i, float(i) if i % 5 == 3 else None) for i in range(23)] + [(None, 7.0)]
    df = spark.createDataFrame(rows, "at int, v double").repartition(4)
    out = cleaning.fill_missing(df, "v", "backward_fill", order="at")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    want = {i: next((float(j) for j in range(i, 23) if j % 5 == 3), 7.0) for i in range(23)} | {None: 7.0}
    assert {r["at"]: r["v"] for r in out.collect()} == want


def test_distinct_counts_are_exact(spark):
    """Beyond what a sketch holds, what is told is counted; the uses are the same either way."""
    df = spark.range(60_000).select(F.concat(F.lit("x"), (F.col("id") % 40_003).cast("string")).alias("word"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("kind"))
    found = profile.describe_columns(df)
    assert [c["distinct"] for c in found] == [40_003, 7]
    rough = profile.describe_columns(df, exact=False)
    assert [{k: v for k, v in c.items() if k != "distinct"} for c in rough] == [{k: v for k, v in c.items() if k != "distinct"} for c in found]


def test_outlier_queries_join_their_frame_once(spark, monkeypatch):
    """Passes over a frame that is joined anew for each would shuffle the large tables as often."""
    from lakeglass import catalog

    read = spark.sparkContext.accumulator(0)

    def counted(k):
        read.add(1)
        return float(k * k)

    rows = spark.range(0, 200, 1, 2).select(F.udf(counted, "double")("id").alias("revenue"), F.lit("a").alias("brand"), F.timestamp_seconds(F.col("id") * 86400).alias("order_date"))
    monkeypatch.setattr(catalog, "skewed", lambda *_: rows)
    assert catalog.QUERIES["anomaly_groups"](spark, "").count() <= 1 and read.value == 200


def test_asked_queries_join_their_frame_once(spark, monkeypatch):
    """Roles, period and trends are passes of their own over one frame."""
    from lakeglass import catalog

    read = spark.sparkContext.accumulator(0)

    def counted(k):
        read.add(1)
        return float(k * k)

    rows = spark.range(0, 200, 1, 2).select(F.udf(counted, "double")("id").alias("revenue"), F.lit("a").alias("brand"), F.timestamp_seconds(F.col("id") * 86400).alias("order_date"))
    monkeypatch.setattr(catalog, "asked", lambda *_: rows)
    for name in ("insight_trends", "insight_kpis", "nlq_total"):
        assert catalog.QUERIES[name](spark, "").count() > 0
    assert read.value == 600


def test_kmeans_keeps_small_partitions(spark, monkeypatch):
    """Every pass of k-means reads a kept partition in one task: its rows have a limit, whatever the files' size."""
    from lakeglass.operators import segmentation

    sizes = []
    plain = segmentation.KMeans.fit
    monkeypatch.setattr(segmentation.KMeans, "fit", lambda self, df: sizes.extend(df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) or plain(self, df))
    monkeypatch.setattr(segmentation, "KEPT_ROWS", 50, raising=False)
    df = spark.range(0, 400, 1, 2).select((F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    assert sum(r.members for r in segmentation.cluster_profiles(df, ["a", "b"], 2).collect()) == 400
    assert sum(sizes) == 400 and max(sizes) <= 60


def test_quality_counts_no_distinct_values(spark, monkeypatch):
    """Constant columns are told by their ends; distinct values of every column would be a shuffle of all of them."""
    monkeypatch.setattr(profile, "distinct_counts", None)
    rows = [("x", "1.5", None, float("nan"), 1), ("x", "-2e3", None, float("nan"), 2), ("x", "n/a", None, float("nan"), None), ("x", "+.5", None, float("nan"), 4)]
    df = spark.createDataFrame(rows, "flat string, mixed string, empty string, nan double, v int")
    found = {(i["kind"], i["column"], i["rows"], i["pct"]) for i in profile.quality_issues(df)}
    assert found == {("constant_column", "flat", 4, 100.0), ("constant_column", "nan", 4, 100.0), ("empty_column", "empty", 4, 100.0), ("mixed_types", "mixed", 3, 75.0), ("suspicious_values", "mixed", 1, 25.0), ("missing_values", "v", 1, 25.0)}
