"""Source divergence audit: what sets the texts of one source apart from the other sources of its language.

Every language keeps the V terms that at least LEAST of its documents have. A group is a (lang, source), and so is the language itself;
a kept term found n times in a group has the smoothed share p = 1 + floor(10^9 (n + 1) / (N + V)), N being the group's occurrences of kept terms. The
distance of p from q is floor((p - q)^2 / q). All of it is integer arithmetic.

1. Each task counts its documents' terms in DuckDB: a row for each (lang, source, term) it met, whatever the number of documents.
2. These rows are dealt to shards by a hash of lang and term, so that a shard has all rows of its terms. DuckDB adds them up there, keeps the
   frequent terms and counts them in the whole language. A source or a word that a third of all rows have is a row for each task of step 1.
3. Spark adds up N and V. They are joined to the kept rows (by groups, a small side that Catalyst broadcasts where it is small).
4. Shards again: DuckDB adds up, for pairs of sources, what the terms that both have differ by, and the TOP terms of each group in the shard.
   Pairs are summed inside the shard and never emitted by term.
5. Spark merges sums and rankings. A term that one of two sources lacks counts there by n = 0. These need no pass over V terms for each pair: what a group's term is
   worth against a group without it depends on its count alone, so a histogram of counts (lang, source, n) gives those sums.

    sum over all terms of f(a, b) = sum over terms in both of [f(pa, pb) - f(pa, b0) - f(a0, pb) + f(a0, b0)]
      + sum over a's terms of [f(pa, b0) - f(a0, b0)] + sum over b's terms of [f(a0, pb) - f(a0, b0)] + V f(a0, b0)

with a0 and b0 the shares of a term that the group lacks.

Defined results: null text, lang and source count as ''. Every row is a document, repeated rows and rows without doc_id too. A group without terms is
listed with all its pairs; with V = 0 they are 0. Ties in value go by the item's UTF-8 bytes. A language of one source has no pairs, and its terms equal the language's, so it
has no rows. An empty table gives none. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Maximal runs of ASCII letters and of all characters beyond ASCII (fixed by the contract).
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, LEAST, TOP = 1_000_000_000, 3, 200
#: What DuckDB may hold in a task before it spills to the task's own folder.
MEMORY = "300MB"


def in_duckdb(sql: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow: `sql` over the task's rows, which it names `shard`. They stream in, and the result streams out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        held = iter(batches)
        first = next(held, None)
        if first is None:
            return

        def all_of() -> Iterator[pa.RecordBatch]:
            yield first
            yield from held

        spill = tempfile.mkdtemp()
        db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False})
        try:
            db.register("shard", pa.RecordBatchReader.from_batches(first.schema, all_of()))
            yield from db.sql(sql).to_arrow_reader(20_000)
        finally:
            db.close()
            shutil.rmtree(spill, ignore_errors=True)

    return run


COUNTS = f"""
SELECT lang, source, e.key AS term, sum(e.value)::BIGINT AS n, count(*)::BIGINT AS docs
FROM (SELECT lang, source, unnest(map_entries(list_aggregate(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'), 'histogram'))) AS e FROM shard)
GROUP BY lang, source, term"""

KEPT = """
SELECT lang, source, term, n, (sum(n) OVER term)::BIGINT AS lang_n, (row_number() OVER term = 1)::BIGINT AS first
FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM shard GROUP BY lang, source, term)
WINDOW term AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER term >= {least}"""

PARTS = """
WITH r AS MATERIALIZED (SELECT * FROM shard),
both_have AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0
        - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0) AS value
    FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
above AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM r WHERE p > q)
SELECT lang, source, 'pair' AS part, item, value::DECIMAL(38, 0) AS value FROM both_have
UNION ALL
SELECT lang, source, 'term', item, value::DECIMAL(38, 0) FROM above QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}"""


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)); null where there is no term."""
    return F.call_function("div", (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), F.nullif((total + terms).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, lang_n (occurrences in the language), first (1 in one row of each term of a language)."""
    held = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = held.mapInArrow(in_duckdb(COUNTS), "lang string, source string, term string, n bigint, docs bigint")
    return counted.repartition("lang", "term").mapInArrow(in_duckdb(KEPT.format(least=least)), "lang string, source string, term string, n bigint, lang_n bigint, first bigint")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    kept = durable(kept_terms(docs, least))
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct().join(per_group, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
    of_lang = Window.partitionBy("lang")  # one row for each source of the language
    groups = named.select("lang", "source", "total", F.sum("firsts").over(of_lang).alias("terms"), F.sum("total").over(of_lang).alias("lang_total"))
    groups = durable(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))))

    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    parts = durable(shares.repartition("lang", "term").mapInArrow(in_duckdb(PARTS.format(top=int(top))), "lang string, source string, part string, item string, value decimal(38,0)"))

    # each source against each other one of its language: as many rows as the result has
    own = groups.select("lang", "source", "terms", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = own.join(other, "lang").where("source != item").withColumn("neither", distance(F.col("p0"), F.col("q0")))
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(groups, ["lang", "source"]).select("lang", "source", "k", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    times = F.col("k").cast("decimal(19,0)")
    one = pairs.join(counts, ["lang", "source"]).select("lang", "source", "item", (times * (distance(F.col("p"), F.col("q0")) - F.col("neither"))).alias("value"))
    two = pairs.join(counts.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (times * (distance(F.col("p0"), F.col("p")) - F.col("neither"))).alias("value"))
    rest = pairs.select("lang", "source", "item", F.coalesce(F.col("terms").cast("decimal(19,0)") * F.col("neither"), F.lit(0)).alias("value"))
    both = parts.where("part = 'pair'").select("lang", "source", "item", "value")
    wide = lambda df: df.withColumn("value", F.col("value").cast("decimal(38,0)"))
    summed = wide(one).unionByName(wide(two)).unionByName(wide(rest)).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))

    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = parts.where("part = 'term'").withColumn("value", F.col("value").cast("long")).withColumn("rank", ranks).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return summed.withColumn("rank", ranks).select(columns).unionByName(terms.select(columns))


def oracle_sql() -> str:
    """The same rows in plain SQL, every group with every kept term."""
    return f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
t AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
sized AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM vocab GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, vocab.term, coalesce(c.n, 0) AS n, lang_n FROM g JOIN vocab USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = vocab.term),
p AS (SELECT lang, source, term, n, (1 + {SCALE}::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v))::BIGINT AS p,
        (1 + {SCALE}::HUGEINT * (lang_n + 1) // (total + v))::BIGINT AS q FROM dense JOIN sized USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= {TOP}"""
