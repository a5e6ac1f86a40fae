"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification over words.

A document is contaminated by an item of n words if some run of its words is within floor((1 - SIMILARITY) * n) word edits of it.

1. Windows of an item's size slide over every document. A window within k edits of an item still has n - 2 - 3k of its word
   triples (an edit breaks three at most), and one at least if n >= 6, as k edits leave one of k + 1 runs of three words whole (items of five
   words: pairs instead). Windows with fewer triples of the benchmark cannot match and are left out without loss.
2. The CGK random walk reads a window's words into a string of 3n symbols: at each step it writes the word under a pointer, which
   then moves on or stays by a random bit of (step, word). Few edits apart becomes few places apart (Hamming).
3. Each table of the LSH samples PLACES places of a walk; windows and items with equal samples are candidates. The number of
   tables follows from the target recall: the share of equal places is measured on the items themselves, edited at random as
   far as the rule allows.
4. Candidates that keep enough of the item's own triples are verified by the exact edit distance of the item to the best run around
   the window.

The benchmark is a query set held against all documents in blocks of at most BLOCK items, so each broadcast is bounded. Windows on
neighbouring places share most words; of a stretch of them every few words one is embedded.

Defined results: null and empty texts match nothing. Items of fewer than MIN_ITEM words are too short to tell and are not
looked for. Words are compared in lower case without the punctuation around them. Repeated items are reported by each id, and repeated
documents by each row; a document with a null doc_id is reported with a null id (and stays in decontaminate()). Items without an id are not looked for. Of
several runs that match an item the nearest gives the distance, so ties make no difference. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

SIMILARITY, MIN_ITEM, BLOCK = 0.8, 5, 10_000
WALKS, PLACES, RECALL = 5, 3, 0.98
AROUND = ".,;:!?\"'()[]{}<>*#|-_`~¡¿«»“”‘’…"
REMEMBERED, SEED = 600_000, 20_240_607
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of each word, by its UTF-8 bytes; 0 for punctuation only."""

    def __missing__(self, word: bytes) -> int:
        bare = word.decode("utf-8", "surrogatepass").lower().strip(AROUND)
        self[word] = h = xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass"), 3) | 1 if bare else 0
        return h


def word_hashes(text: bytes, known: _Hashes) -> np.ndarray:
    """Hashes of a text's words; words of punctuation only are left out."""
    words = text.split()  # at the six separators, which are all that bytes knows
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def grams_of(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of each q words in a row."""
    g = h[: len(h) - q + 1]
    for k in range(1, q):
        g = g * MIX + h[k : len(h) - q + 1 + k]
    return g * np.uint64(0xC2B2AE3D27D4EB4F)


def allowed(n: int) -> int:
    return math.floor((1 - SIMILARITY) * n + 1e-9)


def walk(rows: np.ndarray, rand: np.ndarray) -> np.ndarray:
    """CGK embeddings of windows (rows of word hashes) by one walk: 3n symbols each, 0 beyond the end."""
    n = rows.shape[1]
    padded = np.concatenate([rows, np.zeros((len(rows), 1), np.uint64)], 1)
    at, out, line = np.zeros(len(rows), np.int64), np.empty((len(rows), 3 * n), np.uint64), np.arange(len(rows))
    for j in range(3 * n):
        symbol = padded[line, at]
        out[:, j] = symbol
        at = np.minimum(at + ((symbol * rand[j]) >> np.uint64(63)).astype(np.int64), n)
    return out


def nearest(item: np.ndarray, region: np.ndarray) -> int:
    """Edit distance of the item to the run of region that is closest to it."""
    m = len(region)
    ramp, row = np.arange(m + 1), np.zeros(m + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty(m + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


class Index:
    """The LSH tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        known = _Hashes()
        self.items = [(i, h) for i, text in items if len(h := word_hashes((text or "").encode("utf-8", "surrogatepass"), known)) >= MIN_ITEM]
        rng = np.random.default_rng(SEED)
        self.longest = max((len(h) for _, h in self.items), default=0)
        self.rand = rng.integers(0, 1 << 63, (WALKS, 3 * self.longest), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for k, (_, h) in enumerate(self.items):
            self.by_size[len(h)].append(k)
        self.tables = self._tables_needed(rng)
        self.samples = {n: [(t % WALKS, np.sort(rng.choice(3 * n, PLACES, replace=False))) for t in range(self.tables)] for n in self.by_size}
        self.found: dict[int, list[dict[int, list[int]]]] = {}
        for n, members in self.by_size.items():
            tables: list[dict[int, list[int]]] = []
            for keys in self.keys(np.stack([self.items[k][1] for k in members])):
                table: dict[int, list[int]] = defaultdict(list)
                for k, key in zip(members, keys.tolist(), strict=True):
                    table[key].append(k)
                tables.append(dict(table))
            self.found[n] = tables
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]] = {}
        for q in {self.gram(n) for n in self.by_size}:
            sizes: dict[int, set[int]] = defaultdict(set)
            for _, h in self.items:
                if self.gram(len(h)) == q:
                    for g in grams_of(h, q).tolist():
                        sizes[g].add(len(h))
            grams = np.array(sorted(sizes), np.uint64)
            maybe = np.zeros(1 << 22, bool)
            maybe[(grams >> np.uint64(42)).astype(np.int64)] = True
            self.grams[q] = grams, maybe, [tuple(sorted(sizes[g])) for g in grams.tolist()]
        self.own = [(q := self.gram(len(h)), frozenset(grams_of(h, q).tolist())) for _, h in self.items]
        self.needed = {n: max(1, n - (q := self.gram(n)) + 1 - q * allowed(n)) for n in self.by_size}

    @staticmethod
    def gram(n: int) -> int:
        """Words of the runs that windows of n words are filtered by."""
        return 3 if n >= 6 else 2

    def _tables_needed(self, rng: np.random.Generator) -> int:
        """Tables for the target recall, from the equal places of items and edited copies (a low quantile of them)."""
        shares = []
        for k in rng.permutation(len(self.items))[:100]:
            h = self.items[k][1]
            words = h.tolist()
            for _ in range(allowed(len(h))):
                at, kind = int(rng.integers(len(words))), int(rng.integers(3))
                new = int(rng.integers(1, 1 << 62)) | 1
                words[at : at + (kind != 0)] = [] if kind == 1 and len(words) > 1 else [new]
            words = (words + [0] * len(h))[: len(h)]
            rows = np.stack([h, np.array(words, np.uint64)])
            equal = [np.equal(*walk(rows, r[: 3 * len(h)])).mean() for r in self.rand]
            shares.append(float(np.mean(equal)))
        # unrelated walks agree on no place; the floor bounds the tables at some 500
        p = max(0.2, float(np.quantile(shares, 0.25))) if shares else 1.0
        miss = max(1e-9, 1 - p**PLACES)
        return max(2 * WALKS, math.ceil(math.log(1 - RECALL) / math.log(miss))) if miss < 1 else 2 * WALKS

    def keys(self, rows: np.ndarray) -> list[np.ndarray]:
        """The LSH keys of windows of one size, by table."""
        n = rows.shape[1]
        walks = [walk(rows, r[: 3 * n]) for r in self.rand]
        keys = []
        for t, (w, places) in enumerate(self.samples[n]):
            key = np.full(len(rows), t + 1, np.uint64)
            for place in places:
                key = (key ^ walks[w][:, place]) * MIX
                key ^= key >> np.uint64(29)
            keys.append(key)
        return keys

    def windows(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of the windows to embed, by size."""
        found = {}
        for q, (grams, maybe, sizes) in self.grams.items():
            if len(h) < q:
                continue
            own = grams_of(h, q)
            some = np.flatnonzero(maybe[(own >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(grams, own[some]), len(grams) - 1)
            true = grams[at] == own[some]
            places: dict[int, list[int]] = defaultdict(list)
            for place, i in zip(some[true].tolist(), at[true].tolist(), strict=True):
                for n in sizes[i]:
                    places[n].append(place)
            for n, hits in places.items():
                size = min(n, len(h))
                needed = max(1, self.needed[n] - (n - size))
                if size < n - allowed(n) or len(hits) < needed:
                    continue
                # a window that holds `needed` of the runs holds as many neighbouring ones
                p = np.array(hits)
                first, last = p[: len(p) - needed + 1], p[needed - 1 :]
                lo, hi = np.maximum(0, last + q - size), np.minimum(first, len(h) - size)
                counts = np.maximum(0, hi - lo + 1)
                if not counts.any():
                    continue
                good = np.unique(np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
                fresh = np.diff(good, prepend=-2) != 1  # where a stretch begins
                begin = good[np.maximum.accumulate(np.where(fresh, np.arange(len(good)), 0))]
                found[n] = good[((good - begin) % max(1, n // 8) == 0) | np.append(fresh[1:], True)]
        return found

    def search(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(place of the document, item_id, distance, item's words) for each document and item that match."""
        waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for d, h in enumerate(docs):
            for n, starts in self.windows(h).items():
                waiting[n] += [(d, s) for s in starts.tolist()]
        candidates: dict[tuple[int, int], set[int]] = defaultdict(set)
        for n, places in waiting.items():
            for at in range(0, len(places), 2000):
                part = places[at : at + 2000]
                rows = np.zeros((len(part), n), np.uint64)
                for r, (d, s) in enumerate(part):
                    piece = docs[d][s : s + n]
                    rows[r, : len(piece)] = piece
                for table, keys in zip(self.found[n], self.keys(rows), strict=True):
                    for r, key in enumerate(keys.tolist()):
                        for k in table.get(key, ()):
                            candidates[part[r][0], k].add(part[r][1])
        for (d, k), starts in sorted(candidates.items()):
            item_id, item = self.items[k]
            n, limit = len(item), allowed(len(item))
            best, upto = limit + 1, -1
            q, own = self.own[k]
            for s in sorted(starts):
                if s <= upto:
                    continue
                upto = s + n // 2
                region = docs[d][max(0, s - n) : s + 2 * n + limit]
                # the item's own runs of q words: a run within the limit still has this many of the distinct ones
                if len(region) < q or len(own.intersection(grams_of(region, q).tolist())) < max(1, len(own) - q * limit):
                    continue
                best = min(best, nearest(item, region))
                if best == 0:
                    break
            if best <= limit:
                yield d, item_id, best, n


def _search_block(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))  # at most BLOCK items

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, _Hashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                ids, texts = batch.column(0).slice(at, 500), batch.column(1).slice(at, 500).cast(pa.binary()).to_pylist()
                if len(known) > REMEMBERED:
                    known.clear()
                found = list(index.search([word_hashes(x or b"", known) for x in texts]))
                d, item, best, n = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d, pa.int64())), *(pa.array(x, pa.int64()) for x in (item, best, n))], names=["doc_id", "item_id", "distance", "item_words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id bigint, distance bigint, item_words bigint")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_words for each document and benchmark item that match."""
    ids = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks, items = [], []
    for row in ids.orderBy("item_id", "text").toLocalIterator():  # block by block, never the whole benchmark at once
        items.append((row["item_id"], row["text"]))
        if len(items) == BLOCK:
            blocks.append(_search_block(docs, items))
            items = []
    if items or not blocks:
        blocks.append(_search_block(docs, items))
    return reduce(DataFrame.unionByName, blocks)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that match an item."""
    return without(docs, contamination(docs, benchmark))
