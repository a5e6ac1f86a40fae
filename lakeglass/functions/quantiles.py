"""Exact quantiles by distributed selection: no task ever holds the values of a group.

Spark's percentile() keeps all distinct values of a group in one buffer. Here rows are only counted: first by bins of the value's logarithm (COARSE to a
doubling, so some 270,000 at most whatever the values). A bin that holds a wanted rank and up to SMALL values is then counted by distinct value; one with more by FINE equal bins
between its own extremes, and only what is left in those by distinct value. A bin whose extremes are equal is resolved at once, so columns
with few values end after the first step. Each step is a grouped count, pre-aggregated where the rows are; a window sees bins, or the values of one small bin.
The first step runs at once, as its counts decide whether rows need a second narrow read, and large bins two more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

COARSE, FINE, SMALL = 64, 1 << 16, 1 << 18
#: Beyond the bins of the least double, 2^-1074.
ZERO = 1100 * COARSE
#: Rows that go to the driver and are broadcast; with more, they are written and joined as Spark decides.
HEAD = 20_000


def _coarse(v: Column) -> Column:
    """A number of a bin that does not fall as v rises."""
    size = F.floor(F.log2(F.abs(v)) * COARSE) + ZERO
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size).cast("int")


def _ranks(n: Column, probs: Sequence[float]) -> Column:
    """The places (from 0) on both sides of each quantile's position among n values."""
    at = [(n - 1) * F.lit(float(p)) for p in probs]
    return F.array_distinct(F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil))))


def _wanted(counts: DataFrame, keys: list[str], path: list[str], order: str) -> DataFrame:
    """The rows of `counts` (n values from lo to hi each) that hold a wanted rank, with those ranks and the number of values before."""
    parts = Window.partitionBy(*keys, *path).orderBy(order)
    upto = counts.withColumn("upto", F.col("start") + F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, 0)))
    mine = F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    return upto.withColumn("ranks", mine).where(F.size("ranks") > 0).withColumn("start", F.col("upto") - F.col("n")).drop("upto")


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: Sequence[float], few: bool = False) -> DataFrame:
    """keys, n, q: for each group that has a value the number of values and the quantiles, linear between the two nearest values.

    Null values count for nothing; null keys are a group. Without keys there is one row, of nulls if there is no value. few: the caller knows that the groups are few (they are columns, say); otherwise up to HEAD wanted rows
    say so.
    """
    k = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    held = rows.select(*k, F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL").withColumn("bin", _coarse(F.col("v")))
    cells = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]

    coarse = held.groupBy(*names, "bin").agg(*cells)
    total = coarse.withColumn("total", F.sum("n").over(Window.partitionBy(*names)))
    first = _wanted(total.withColumn("ranks", _ranks(F.col("total"), probs)).withColumn("start", F.lit(0).cast("long")), names, [], "bin")

    def inside(at: DataFrame, path: list[str], left: DataFrame) -> DataFrame:
        """Rows of `left` in a bin of `at`, with that bin's extremes."""
        bins = at.select(*(F.col(c).alias(f"{c}_") for c in (*names, *path)), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "ranks", "start", "total")
        on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names] + [F.col(c) == F.col(f"{c}_") for c in path]
        return left.join(F.broadcast(bins) if few else bins, on)

    again = [F.first(c).alias(c) for c in ("ranks", "start", "total")]

    def by_value(at: DataFrame, path: list[str], left: DataFrame) -> DataFrame:
        counts = inside(at, path, left).groupBy(*names, *path, "v").agg(F.count("*").alias("n"), *again)
        return _wanted(counts, names, path, "v").withColumn("lo", F.col("v"))

    # two rows at most for each quantile of a group: to the driver if they are few, else to the shared folder
    head = first.toArrow() if few else first.limit(HEAD + 1).toArrow()
    few = few or head.num_rows <= HEAD
    first = rows.sparkSession.createDataFrame(head, first.schema) if few else written(first)
    open_ = first.where("lo < hi")
    most = open_.agg(F.max(F.when(F.col("n") <= SMALL, F.col("n"))), F.max(F.when(F.col("n") > SMALL, F.col("n")))).first()
    ends = [first.where("lo = hi")]
    if most[0]:
        ends.append(by_value(open_.where(F.col("n") <= SMALL), ["bin"], held))
    if most[1]:
        large = inside(open_.where(F.col("n") > SMALL), ["bin"], held)
        step = F.least(F.floor((F.col("v") - F.col("lo_")) / (F.col("hi_") - F.col("lo_")) * FINE), F.lit(FINE - 1)).cast("int")
        stepped = large.withColumn("step", step)
        second = _wanted(stepped.groupBy(*names, "bin", "step").agg(*cells, *again), names, ["bin"], "step")
        ends += [second.where("lo = hi"), by_value(second.where("lo < hi"), ["bin", "step"], stepped.select(*names, "v", "bin", "step"))]
    places = None
    for at in ends:
        found = at.select(*names, "total", F.explode("ranks").alias("rank"), "lo")
        places = found if places is None else places.unionByName(found)
    # two entries for each quantile of a group
    got = places.groupBy(*names).agg(F.max("total").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))
    pick = []
    for p in probs:
        position = (F.col("n") - 1) * F.lit(float(p))
        below, above = (F.element_at("at", f(position).cast("long")) for f in (F.floor, F.ceil))
        pick.append(F.when(below == above, below).otherwise((F.floor(position) + 1 - position) * below + (position - F.floor(position)) * above))
    return got.select(*(F.col(a).alias(c) for a, c in zip(names, keys, strict=True)), "n", F.array(*pick).alias("q"))
