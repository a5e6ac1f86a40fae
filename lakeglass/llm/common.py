"""Helpers shared by the text operators: tables, durable intermediate results and bounded samples."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR (fixed by the contract).
WORD = r"[^\x20\x09-\x0D]+"
#: The separators between words, for Java's split().
GAP = r"[\x20\x09-\x0D]+"
#: The separators as characters, for translate().
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local session that names none gets a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lakeglass-")
        atexit.register(shutil.rmtree, named[7:], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation.

    The files live as long as the session, as the result is read lazily. rows_per_file (0: any number) is for rows of several MB: a
    writer holds 100 rows before it looks at their size, and a reader 4,096 of a file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeglass/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has already ended
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, whatever the optimizer does with the expression."""
    return F.transform(F.array(value), body).getItem(0)


def crc(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo a number."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def bounded_sample(df: DataFrame, key: str, kind: str, per_kind: int, max_kinds: int = 1000) -> DataFrame:
    """About per_kind rows of each value of kind, chosen by a hash of key: the same rows at every run and partitioning.

    A class with fewer rows is taken whole. The rows returned number about per_kind x classes, whatever df's size; more than max_kinds
    classes are refused, not cut.
    """
    counts = df.where(F.col(kind).isNotNull()).groupBy(kind).count().limit(max_kinds + 1).collect()
    if len(counts) > max_kinds:
        raise ValueError(f"{kind!r} has more than {max_kinds} values")
    counts.sort(key=lambda r: (-r["count"], str(r[kind])))
    if not counts:
        return df.where(F.lit(False))
    keep = F.lit(False)
    for value, n in counts:
        share = F.pmod(F.xxhash64(F.lit(1729), F.col(key)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, per_kind / n))
        keep = keep | ((F.col(kind) == value) & share)
    return df.where(keep)


#: Ids up to this number are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is among ids. Rows with a null key stay."""
    gone = durable(ids.select(key).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")
