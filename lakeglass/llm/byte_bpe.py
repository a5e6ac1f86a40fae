"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

A text is cut by the vocabulary's pattern. A pre-token that is an entry itself is resolved by one probe of a minimal perfect
hash (hash and displace). Any other is merged from its bytes: the bytes form a linked list, a heap holds the ranks of the
neighbouring pairs, and the lowest rank (leftmost of equals) is merged until no pair has a rank, in O(n log n).

Defined results: a null text is empty, an empty text has no ids. Texts of any length are encoded whole. Each row gives
a row, in the order and partitions of the input: repeated rows repeated ones, a null doc_id a null one. Equal ranks cannot arise, and of equal pairs the leftmost is merged. Extra
columns are left out, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Pre-tokens that a worker remembers with their ids; it starts anew beyond that.
REMEMBERED = 500_000
#: Rank files beyond this size are refused, as they are broadcast.
MAX_RANK_BYTES = 64 << 20
MASK, MASK64, SPREAD = (1 << 32) - 1, (1 << 64) - 1, 0x9E3779B97F4A7C15


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class PerfectHash:
    """A minimal perfect hash over byte strings: n keys fill n slots. get() returns a key's value, None for other strings.

    Keys fall into n/4 buckets; bucket by bucket, largest first, a displacement is searched that sends its keys to free
    slots. A bucket of one key stores its slot itself, as a negative number.
    """

    def __init__(self, items: dict[bytes, int]):
        self.n = n = max(1, len(items))
        self.buckets = max(1, (n + 3) // 4)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        grouped: dict[int, list[bytes]] = {}
        for key in items:
            grouped.setdefault(xxhash.xxh64_intdigest(key) % self.buckets, []).append(key)
        free = np.ones(n, bool)
        tries = np.arange(1024, dtype=np.uint64)
        for b, keys in sorted(grouped.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(keys) == 1:
                continue
            halves = [self._halves(k) for k in keys]
            first = 0
            while True:
                slots = np.stack([self._places(x, y, tries + np.uint64(first), n) for x, y in halves])
                fits = free[slots].all(0)
                ordered = np.sort(slots, axis=0)
                fits &= (ordered[1:] != ordered[:-1]).all(0)
                if fits.any():
                    break
                first += len(tries)
            at = int(fits.argmax())
            self.shift[b] = first + at
            free[slots[:, at]] = False
            for key, slot in zip(keys, slots[:, at].tolist(), strict=True):
                self.keys[slot], self.values[slot] = key, items[key]
        left = iter(np.flatnonzero(free).tolist())
        for b, keys in sorted(grouped.items()):
            if len(keys) == 1:
                slot = next(left)
                self.shift[b] = -1 - slot
                self.keys[slot], self.values[slot] = keys[0], items[keys[0]]

    @staticmethod
    def _halves(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(key, 1)
        return h >> 32, (h & MASK) | 1

    @staticmethod
    def _places(x: int, y: int, d: np.ndarray, n: int) -> np.ndarray:
        """The slots of a key for displacements d; get() has the same formula."""
        mixed = (np.uint64(x) + d * np.uint64(y)) * np.uint64(SPREAD)
        return ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)

    def get(self, key: bytes) -> int | None:
        d = self.shift[xxhash.xxh64_intdigest(key) % self.buckets]
        if d < 0:
            slot = -1 - d
        else:
            h = xxhash.xxh64_intdigest(key, 1)
            slot = ((((h >> 32) + d * ((h & MASK) | 1)) * SPREAD & MASK64) >> 32) % self.n
        return self.values[slot] if self.keys[slot] == key else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece that is no entry of the vocabulary."""
    n = len(piece)
    after = list(range(1, n + 1))  # where the token that starts here ends; -1: no token starts here any more
    before = list(range(-1, n - 1))
    rank = ranks.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, start, mid, end = heapq.heappop(heap)
        if after[start] != mid or after[mid] != end:
            continue  # one of the two has been merged meanwhile
        after[start], after[mid] = end, -1
        if end < n:
            before[end] = start
            stop = after[end]
            if (r := rank(piece[start:stop])) is not None:
                heapq.heappush(heap, (r, start, end, stop))
        if (prev := before[start]) >= 0 and (r := rank(piece[prev:end])) is not None:
            heapq.heappush(heap, (r, prev, start, end))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class _Pieces(dict):
    """Pre-token to its ids as little-endian 32-bit integers."""

    def __init__(self, table: PerfectHash, ranks: dict[bytes, int]):
        super().__init__()
        self.table, self.ranks = table, ranks

    def __missing__(self, token: str) -> bytes:
        piece = token.encode()
        whole = self.table.get(piece)
        ids = np.array([whole] if whole is not None else merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            self[token] = ids
        return ids


class ByteBpe:
    """Encoder and decoder for a rank table and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        compiled = regex.compile(pattern)
        self.groups = compiled.groups
        self.split = compiled.finditer if self.groups else compiled.findall
        self.pieces = _Pieces(PerfectHash(ranks), ranks)
        self.token: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found = self.split(text)
        if self.groups:
            found = (m[0] for m in found)
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(ranks: dict[bytes, int], pattern: str, name: str) -> ByteBpe:
    """A worker's encoder, built once."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = ByteBpe(ranks, pattern)
    return _ENCODERS[name]


def byte_bpe(docs: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: its id, n_tokens, ids (binary, little-endian 32-bit; if keep_ids), ids_sha256, decoded (if keep_ids), decoded_sha256.

    Rows are encoded where they are read: no shuffle. The vocabulary is broadcast; its size is checked on loading.
    """
    ranks = load_ranks(rank_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value, pattern, name)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                plain = bpe.decode(ids)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest()) + ((ids, plain.decode("utf-8", "replace")) if keep_ids else ()))
            columns = list(zip(*out, strict=True)) or [()] * (5 if keep_ids else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    id_type = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
    schema = f"`{id_column}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep_ids else "")
    return docs.select(id_column, text_column).mapInArrow(run, schema)
