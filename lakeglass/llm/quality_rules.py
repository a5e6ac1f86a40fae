"""Risk-controlled quality rules, in built-in functions only.

The rules reject a document if any of its features reaches that feature's cutoff. How strict they may be is not chosen by
hand: the cutoffs of all rules tighten together along one path fixed in advance, and on labelled documents of good quality an exact
binomial test decides for every stratum (language) how far along it is safe: with probability 1 - delta no stratum
loses more than a share alpha of its good documents to all rules together.

- A step's loss is counted for the rules jointly, so alpha is not divided among them.
- The steps are nested (a document that one rejects, the next ones reject too) and tested from lax to strict, ending at the first
  failure. Testing in a fixed order needs no correction among the steps; for the strata, delta is divided by their
  number (Bonferroni).
- The p-value of a step is P(X <= k) for X binomial(n, alpha), where the step rejects k of the stratum's n good labelled
  documents. It is at most delta / strata exactly if the Clopper-Pearson bound is within the risk.
- A stratum with too few labels (fewer than 144 at four strata) gets no cutoffs: nothing is rejected without evidence.

Defined results: a null text counts as empty (it fails the base rules). A null language is a stratum of its own, named ''.
Null labels and labels of unknown documents are left out; a document labelled more than once counts once, as good if any
of its labels says so. Rows of `documents` are judged one by one, so repeated rows give repeated results. In the test a labelled document of several
rows counts once in a stratum, and as rejected by a step if any of its rows there is: copies are no evidence. A null doc_id has no label and is judged like any other. A feature equal to its cutoff is rejected. No documents: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let, without, words_of

#: Feature of a rule, and its cutoffs along the path, from lax to strict.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08],
    "repeat_share": [0.3, 0.28, 0.26, 0.24, 0.22, 0.2, 0.17, 0.14, 0.11, 0.08],
    "dup_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.3, 0.2],
    "shout_share": [2.0, 1.8, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3],
    "capital_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3],
    "mean_word": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0],
}
ALPHA, DELTA = 0.03, 0.05
#: Limits of the base rules (fixed by the contract).
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Strata up to this number are broadcast with their cutoffs; more are joined by a shuffle.
BROADCAST_STRATA = 10_000


def _covered(places: Column) -> Column:
    """Words that windows starting at these ascending places cover."""
    return F.aggregate(F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that are found twice or more in the text.

    Windows are compared by 64-bit hashes. Only a text that has a repeated window pays for the sort.
    """

    def of_sorted(s: Column) -> Column:
        h = lambda i: F.get(s, i)["h"]
        twins = F.filter(s, lambda x, j: F.coalesce(h(j - 1) == x["h"], F.lit(False)) | F.coalesce(h(j + 1) == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twins, lambda x: x["i"])), _covered)

    def of_windows(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, of_sorted))

    def of_hashes(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return let(F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))), of_windows)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts, n_capitals."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = let(words_of(t), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), F.size(F.array_distinct(x)).alias("n_unlike")))
    named = docs.withColumns({"_w": counted, "_l": by_line, "_c": F.length(t) - count(r"[\x20\x09-\x0D]"), "_s": count("[#*$%&|<>]"), "_b": count("!"), "_u": count("[A-Z]")})
    return named.withColumns(
        {
            "n_words": F.col("_w.n_words").cast("long"),
            "word_chars": F.col("_c").cast("long"),
            "n_symbols": F.col("_s").cast("long"),
            "n_dup_lines": (F.col("_l.n_lines") - F.col("_l.n_unlike")).cast("long"),
            "n_repeat_words": F.col("_w.n_repeat_words").cast("long"),
            "n_lines": F.col("_l.n_lines").cast("long"),
            "n_shouts": F.col("_b").cast("long"),
            "n_capitals": F.col("_u").cast("long"),
        }
    ).drop("_w", "_l", "_c", "_s", "_b", "_u")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """The rules' features; 0 where the denominator is."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "shout_share": share("n_shouts", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "mean_word": share("word_chars", "n_words"),
    }


def _ln_factorial(n: Column) -> Column:
    """ln n!: exact up to 20, from there by Stirling's series (error below 1e-15)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p); 1 where k is at or over the mean (such a cutoff never passes).

    Summed downwards from k by the ratio of neighbouring terms; terms further than 40 standard deviations away are nil.
    """
    top = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    reach = F.least(k, (40 * F.sqrt(n * p) + 50).cast("long"))
    steps = F.when(reach > 0, F.sequence(F.lit(0).cast("long"), reach - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.when(k >= n * p, F.lit(1.0)).otherwise(top * F.aggregate(steps, start, down, lambda acc: acc["sum"]))


def _rejected(step: Column | int, rules: dict[str, list[float]]) -> Column:
    """Some feature reaches its cutoff of a step (from 0)."""
    found = F.lit(False)
    for r, grid in rules.items():
        cut = F.lit(grid[step]) if isinstance(step, int) else F.get(F.array(*map(F.lit, grid)), step)
        found = found | F.coalesce(F.col(r) >= cut, F.lit(False))
    return found


def steps(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, list[float]] = RULES) -> DataFrame:
    """stratum, n (good labelled documents) and step, the strictest certified one (null: none), for each stratum with such documents.

    measured: doc_id, stratum, base_failed and the features. labels: doc_id, quality.
    """
    length = {len(grid) for grid in rules.values()}
    if len(length) != 1 or any(grid != sorted(grid, reverse=True) for grid in rules.values()):
        raise ValueError("the rules' cutoffs must be equally many, and fall along the path")
    path = range(length.pop())
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where(F.col("quality") == 1).select("doc_id")
    held = measured.where(~F.col("base_failed")).join(good, "doc_id").groupBy("stratum", "doc_id").agg(*(F.max(_rejected(i, rules)).alias(f"r{i}") for i in path))
    counted = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(f"r{i}").alias(f"k{i}") for i in path))
    strata = measured.agg(F.count_distinct("stratum")).first()[0]
    fails = F.array(*(F.when(binomial_tail(F.col("n"), F.col(f"k{i}"), alpha) > delta / max(1, strata), F.lit(i)) for i in path))
    last = F.coalesce(F.array_min(fails), F.lit(len(path))) - 1
    return counted.select("stratum", "n", F.when(last >= 0, last).alias("step"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, list[float]] = RULES) -> DataFrame:
    """One row per document: doc_id, stratum, the counts, the features, base_failed, the step and cutoffs in force and kept."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_capitals"]
    slim = docs.select("doc_id", "text", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"))
    # the texts are read once; what follows works on a narrow table
    measured = durable(signals(slim).select("doc_id", "stratum", *counts, base_failed().alias("base_failed"))).withColumns(features())
    certified = durable(steps(measured, labels, alpha, delta, rules)).select("stratum", "step")
    if certified.count() <= BROADCAST_STRATA:
        certified = F.broadcast(certified)
    joined = measured.join(certified, "stratum", "left")
    cuts = {f"{r}_cut": F.get(F.array(*map(F.lit, grid)), F.col("step")) for r, grid in rules.items()}
    return joined.withColumns(cuts).withColumn("kept", ~F.col("base_failed") & ~_rejected(F.col("step"), rules))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that are kept. A doc_id that any of its rows fails goes with all of them; rows with a null doc_id are judged by the base rules."""
    judged = quality_rules(docs.where(F.col("doc_id").isNotNull()), labels)
    named = without(docs.where(F.col("doc_id").isNotNull()), judged.where(~F.col("kept")))
    nameless = signals(docs.where(F.col("doc_id").isNull()).select(F.struct("*").alias("row"), "text")).where(~base_failed()).select("row.*")
    return named.select(docs.columns).unionByName(nameless)


def oracle_sql(alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, list[float]] = RULES) -> str:
    """DuckDB SQL for doc_id, the base counts, base_failed and kept over tables documents and labels."""
    path = range(len(next(iter(rules.values()))))
    rejected = lambda i: "(" + " OR ".join(f"{r} >= {grid[i]!r}" for r, grid in rules.items()) + ")"
    tail = "list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a!r}) + (n - j) * ln({b!r}))))".format(a=alpha, b=1 - alpha)
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
spans AS (
  SELECT rid, p, array_to_string(words[p:p + {WINDOW - 1}], ' ') AS g
  FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS u(p)),
twice AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM spans),
runs AS (SELECT rid, least({WINDOW}, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p) - p, {WINDOW})) AS c FROM twice WHERE n > 1),
covered AS (SELECT rid, sum(c) AS n_repeat_words FROM runs GROUP BY rid),
counted AS (
  SELECT w.rid, doc_id, stratum, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)),
base AS (
  SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counted),
measured AS (
  SELECT *, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(n_shouts / nullif(n_words, 0), 0) AS shout_share,
         coalesce(n_capitals / nullif(word_chars, 0), 0) AS capital_share, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word
  FROM base),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
tests AS (
  SELECT stratum, i AS step, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER (WHERE CASE i {" ".join(f"WHEN {i} THEN {rejected(i)}" for i in path)} END) AS k
  FROM measured JOIN good USING (doc_id), range({len(path)}) AS s(i) WHERE NOT base_failed GROUP BY stratum, i),
judged AS (SELECT stratum, step, k < n * {alpha!r} AND {tail} <= {delta!r} / (SELECT greatest(1, count(DISTINCT stratum)) FROM measured) AS passed FROM tests),
certified AS (SELECT stratum, coalesce(min(step) FILTER (WHERE NOT passed), {len(path)}) - 1 AS step FROM judged GROUP BY stratum)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(CASE step {" ".join(f"WHEN {i} THEN {rejected(i)}" for i in path)} END, false) AS kept
FROM measured LEFT JOIN certified USING (stratum)"""
