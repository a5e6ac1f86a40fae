"""The test tables as frames, and the wide frame of their star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without a zone are read as UTC."""
    path = f"{sf_dir}/{name}.parquet"
    own = spark.read.parquet(path).schema
    # by the schema, not by a cast above the scan, which filters could not pass
    fields = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in own]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order, customer, nation, region and part. Spark broadcasts the sides that its size estimate allows."""
    t = lambda name: table(spark, sf_dir, name)
    out = lineitem(spark, sf_dir).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return out.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
