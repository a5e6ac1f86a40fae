"""Clustering: standardised features, k-means and two principal components by Spark's own distributed algorithms.

Cluster numbers differ from those of other k-means implementations (deviation D7); they are ordered by size here.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import share
from ..plans.compile import kind_of, number, quoted
from ..plans.requests import need

SEED = 42
#: Rows of a partition that k-means keeps: every pass of it reads them from one task's memory.
KEPT_ROWS = 1_000_000


def features(df: DataFrame, columns: list[str], entity: str | None = None) -> tuple[DataFrame, list[str]]:
    """Complete rows (or means by entity) with z-scores z0..zn by the population deviation; columns that do not vary go."""
    rows = df.select(*([quoted(entity).alias("entity")] if entity else []), *(number(df, c).alias(f"v{i}") for i, c in enumerate(columns)))
    if entity:
        kind_of(df, entity)
        rows = rows.where("entity IS NOT NULL").groupBy("entity").agg(*(F.avg(f"v{i}").alias(f"v{i}") for i in range(len(columns))))
    rows = rows.dropna(subset=[f"v{i}" for i in range(len(columns))])
    r = rows.agg(*(F.avg(f"v{i}").alias(f"m{i}") for i in range(len(columns))), *(F.stddev_pop(f"v{i}").alias(f"s{i}") for i in range(len(columns)))).first()
    used = [i for i in range(len(columns)) if r[f"s{i}"]]
    need(len(used) >= 2, "clustering needs two columns that vary")
    z = [((F.col(f"v{i}") - r[f"m{i}"]) / r[f"s{i}"]).alias(f"z{k}") for k, i in enumerate(used)]
    return rows.select(*(["entity"] if entity else []), *(F.col(f"v{i}").alias(columns[i]) for i in used), *z), [columns[i] for i in used]


def clusters(df: DataFrame, columns: list[str], k: int = 4, entity: str | None = None) -> tuple[DataFrame, list[str]]:
    """The feature rows with a cluster from 1 (the largest)."""
    need(2 <= k <= 10, "2 to 10 clusters")
    rows, used = features(df, columns, entity)
    vectors = VectorAssembler(inputCols=[f"z{i}" for i in range(len(used))], outputCol="features").transform(rows)
    held, parts = vectors.select("features"), -(-vectors.count() // KEPT_ROWS)
    model = KMeans(k=k, seed=SEED, maxIter=100).fit(held.repartition(parts) if parts > held.rdd.getNumPartitions() else held)
    placed = model.transform(vectors)
    # k rows
    names = placed.groupBy("prediction").count().withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("count"), "prediction"))).select("prediction", "cluster")
    return placed.join(F.broadcast(names), "prediction").drop("prediction"), used


def cluster_profiles(df: DataFrame, columns: list[str], k: int = 4, entity: str | None = None) -> DataFrame:
    """cluster, members, members_pct, and for each feature its mean and z-score."""
    rows, used = clusters(df, columns, k, entity)
    out = rows.groupBy("cluster").agg(F.count("*").alias("members"), *(F.avg(quoted(c)).alias(f"mean_{c}") for c in used), *(F.avg(f"z{i}").alias(f"z_{c}") for i, c in enumerate(used)))
    return out.withColumn("members_pct", share(F.col("members"), F.sum("members").over(Window.partitionBy()))).orderBy("cluster")


def cluster_features(profiles: DataFrame, most: int = 3) -> DataFrame:
    """cluster, rank, feature, z of the features that tell each cluster most from the whole, by cluster_profiles()."""
    names = [c[2:] for c in profiles.columns if c.startswith("z_")]
    each = F.array(*(F.struct(F.abs(quoted(f"z_{c}")).alias("size"), F.lit(c).alias("feature"), quoted(f"z_{c}").alias("z")) for c in names))
    first = F.slice(F.sort_array(each, asc=False), 1, most)
    return profiles.select("cluster", F.posexplode(first).alias("at", "x")).select("cluster", (F.col("at") + 1).alias("rank"), "x.feature", "x.z")


def principal_components(df: DataFrame, columns: list[str], entity: str | None = None) -> tuple[DataFrame, float]:
    """x, y of each complete row on the first two components (signs such that the largest loading is positive), and the share explained."""
    rows, used = features(df, columns, entity)
    vectors = VectorAssembler(inputCols=[f"z{i}" for i in range(len(used))], outputCol="features").transform(rows)
    model = PCA(k=2, inputCol="features", outputCol="p").fit(vectors)
    loadings = model.pc.toArray()  # features x 2
    signs = [1.0 if abs(loadings[:, j].max()) >= abs(loadings[:, j].min()) else -1.0 for j in range(2)]
    p = vector_to_array("p")
    out = model.transform(vectors).select(*(["entity"] if entity else []), (p[0] * signs[0]).alias("x"), (p[1] * signs[1]).alias("y"))
    return out, float(sum(model.explainedVariance.toArray()))
