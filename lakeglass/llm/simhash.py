"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A text's fingerprint has a bit set if more than half of its word shingles' XXH64 hashes have it set.
2. Only distinct fingerprints are compared, each with the smallest doc_id that has it.
3. The 64 bits are dealt to PARTS partitions of equal width such that correlated bits share one: bits that say the same
   cost selectivity once instead of in every partition.
4. For a limit of t differing bits and partition limits t_1..t_m with sum(t_i + 1) = t + 1, two fingerprints within t differ
   by at most t_i in some partition i (t_i = -1: not probed). For each fingerprint, dynamic programming picks the limits with the
   fewest candidates, which the value counts of the partitions give. With 16-bit partitions those counts are a table of fixed size.
5. Fingerprints are indexed by (partition, value) and probed by their own limits; pairs that meet are verified.
6. A value that more than CROWD fingerprints share would give all their pairs. Its members instead emit their own fingerprint
   and its one-bit neighbours: two fingerprints within 2 bits have one of those in common and those that share one are
   within 2 bits, so hooking each to the smallest one at that key yields the same components with a fixed number of rows each.

Links then give connected components. Nothing grows with the square of a group.

Defined results: null, empty and blank texts have the fingerprint zero and are linked like any other. Rows with the same doc_id
are separate rows of one document. Every row of the input gets its component; a row with a null doc_id has that of the rows of its fingerprint
that have one, and null if there are none. Ties cannot arise: a component is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, without
from .components import connected_components
from .quality_model import split_words

BITS, PARTS, WIDTH, CROWD = 64, 4, 16, 48
SEED = 42
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fingerprint(text: str, shingle: int = 3) -> int:
    words = [w.encode("utf-8", "surrogatepass") for w in split_words(text.translate(UPPER))]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        starts = [0, *ends[:-shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in blocks
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, f (the fingerprint's 64 bits as a signed bigint)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(x.as_py() or "", shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.int64())], names=["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f bigint")


def _bits(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(f, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(distinct: DataFrame) -> list[list[int]]:
    """PARTS groups of WIDTH bits, correlated ones together. Counts of pairs of bits: 64 x 64 numbers from each task, added up."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS, BITS))
        n = 0
        for frame in frames:
            bits = _bits(frame["f"].to_numpy()).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n).astype(np.int64)})

    cells = {r["cell"]: r["n"] for r in distinct.select("f").mapInPandas(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = max(1, cells.get(BITS * BITS, 0))
    both = np.array([cells.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = list(range(BITS)), []
    for _ in range(PARTS):
        pairs = like[np.ix_(left, left)] - 2 * np.eye(len(left))
        group = [left[int(pairs.argmax() // len(left))]]
        while len(group) < WIDTH:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (like[b, group].sum(), -b)))
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def values(f: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of each fingerprint in each partition."""
    bits = _bits(f)
    return np.stack([bits[:, g].astype(np.int64) @ (1 << np.arange(WIDTH)) for g in groups], 1)


def limits(near: np.ndarray, budget: int) -> np.ndarray:
    """For each fingerprint, limits t_i with sum(t_i + 1) = budget and the fewest candidates, by dynamic programming.

    near[t, q, i]: candidates of fingerprint q in partition i with limit t. Ties go to the smaller limit in earlier partitions.
    """
    depth, n, parts = near.shape
    cost = np.full((n, budget + 1), np.inf)
    cost[:, 0] = 0
    chosen = np.zeros((parts, n, budget + 1), np.int64)
    for i in range(parts):
        new, pick = cost.copy(), np.zeros((n, budget + 1), np.int64)
        for spent in range(1, min(depth, budget) + 1):
            for total in range(spent, budget + 1):
                c = cost[:, total - spent] + near[spent - 1, :, i]
                better = c < new[:, total]
                new[better, total], pick[better, total] = c[better], spent
        cost, chosen[i] = new, pick
    out, left = np.zeros((n, parts), np.int64), np.full(n, budget)
    for i in reversed(range(parts)):
        out[:, i] = chosen[i][np.arange(n), left] - 1
        left = left - out[:, i] - 1
    return out


def _counts(distinct: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each value of each partition: PARTS x 65,536 numbers, whatever the input's size."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for frame in frames:
            v = values(frame["f"].to_numpy(), groups)
            for i in range(PARTS):
                seen[i] += np.bincount(v[:, i], minlength=1 << WIDTH)
        at = np.flatnonzero(seen)
        if len(at):
            yield pd.DataFrame({"cell": at.astype(np.int32), "n": seen.ravel()[at]})

    got = distinct.select("f").mapInPandas(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(PARTS << WIDTH, np.int64)
    counts[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return counts.reshape(PARTS, 1 << WIDTH)


def links(distinct: DataFrame, limit: int = 2, crowd: int = CROWD) -> DataFrame:
    """a, b: pairs of representatives that connect all fingerprints within `limit` bits. distinct: f, rep."""
    if limit != 2:
        raise ValueError("crowded values are resolved for a limit of 2 bits")
    groups = bit_groups(distinct)
    counts = _counts(distinct, groups)
    flips = 1 << np.arange(WIDTH)
    near = np.arange(1 << WIDTH)
    # candidates at distance 0 and at distance up to 1; a crowded value among the latter rules that limit out
    around = np.stack([c[near ^ b] for c in counts for b in flips]).reshape(PARTS, WIDTH, -1)
    exact = counts.astype(np.float64)
    one = exact + around.sum(1)
    one[(counts > crowd) | (around > crowd).any(1)] = np.inf
    # a crowded value costs each of its members a fixed number of rows
    exact = np.where(counts > crowd, float(BITS - WIDTH + 1), exact)
    shared = distinct.sparkSession.sparkContext.broadcast((groups, counts, exact, one))  # of fixed size

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, counts, exact, one = shared.value
        other = [np.array([np.int64(np.uint64(1 << b).astype(np.int64)) for b in range(BITS) if b not in g]) for g in groups]
        for frame in frames:
            for at in range(0, len(frame), 2000):
                f, rep = frame["f"].to_numpy()[at : at + 2000], frame["rep"].to_numpy()[at : at + 2000]
                v = values(f, groups)
                cost = np.stack([np.stack([table[i][v[:, i]] for i in range(PARTS)], 1) for table in (exact, one)])
                t = limits(cost, limit + 1)
                for i in range(PARTS):
                    dense = counts[i][v[:, i]] > crowd
                    # index rows: every value that is not crowded; probes: by this fingerprint's limits
                    for kind, chosen, key in [("x", ~dense, v[:, i]), ("p", ~dense & (t[:, i] >= 0), v[:, i]), *(("p", t[:, i] >= 1, v[:, i] ^ b) for b in flips)]:
                        if chosen.any():
                            yield pd.DataFrame({"kind": kind, "part": i, "key": key[chosen], "f": f[chosen], "rep": rep[chosen]})
                    if dense.any():
                        for flip in [np.int64(0), *other[i]]:
                            yield pd.DataFrame({"kind": "s", "part": i, "key": f[dense] ^ flip, "f": f[dense], "rep": rep[dense]})

    rows = durable(distinct.mapInPandas(run, "kind string, part int, key bigint, f bigint, rep bigint"))
    index, probes = (rows.where(F.col("kind") == k).select("part", "key", F.col("f").alias(f"f{k}"), F.col("rep").alias(k)) for k in "xp")
    pairs = probes.join(index, ["part", "key"]).where((F.col("fx") != F.col("fp")) & (F.bit_count(F.col("fx").bitwiseXOR(F.col("fp"))) <= limit)).select(F.col("p").alias("a"), F.col("x").alias("b"))
    stars = rows.where(F.col("kind") == "s").select("part", "key", "rep")
    hub = stars.groupBy("part", "key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("part", "key", "hub")
    hooked = stars.join(hub, ["part", "key"]).select(F.col("rep").alias("a"), F.col("hub").alias("b")).where("a != b")
    return pairs.unionByName(hooked)


def simhash_components(docs: DataFrame, shingle: int = 3, limit: int = 2) -> DataFrame:
    """doc_id, f, component_id for each row of docs; doc_id is an integer or null, which has the component of its fingerprint."""
    marked = durable(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle))
    distinct = durable(marked.groupBy("f").agg(F.min("doc_id").alias("rep")))
    # fingerprints of rows without an id only have nothing to name their links by
    joined = durable(connected_components(links(distinct.where("rep IS NOT NULL"), limit)))
    classes = distinct.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("f", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(classes, "f")


def near_dedup(docs: DataFrame, shingle: int = 3, limit: int = 2) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id. Rows with a null doc_id stay."""
    found = simhash_components(docs.where(F.col("doc_id").isNotNull()), shingle, limit)
    return without(docs, found.where("doc_id != component_id"))
