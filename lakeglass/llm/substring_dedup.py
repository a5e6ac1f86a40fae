"""Removal of repeated substrings by prefix-free parsing.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller doc_id. The strings are never
written out: the corpus is parsed at content-defined triggers, and order is only worked out where the parse leaves a doubt.

1. Parse. A rolling hash runs over all GRAM-byte strings. A place is a trigger if its hash is the smallest within some SPAN-byte
   string (leftmost of equals), so every such string holds one, at an offset that its own bytes fix. A trigger and the strings
   it is chosen for make a phrase: it ends SPAN - GRAM bytes at most beyond the trigger on either side.
2. Phrases meet by trigger. A slice of documents sends each of its distinct phrases once, as two 32-bit hashes and the smallest
   doc_id. All strings of a phrase that a smaller document also has are repeats: this settles copies of any length without
   looking at their bytes.
3. Triggers with several distinct phrases from several documents are in doubt: their phrases are compared byte by byte. A phrase
   is cut at its trigger into a left and a right half that overlap in it. The distinct halves are the dictionary; a suffix of a
   left half ends in the trigger, so no suffix is a prefix of another. The suffix array of the dictionary and the order of the
   parse (left, right) together give the order of all strings of the block (by left suffix, then by right half);
   equal strings are neighbours there, told by their common prefix.
4. A trigger with very many phrases (CROWD, or MOST in one slice) is split: each of its strings is sent by its own hash
   instead, once from each slice, to the same comparison. So no trigger, phrase or string gathers in one task.

Documents are dealt to slices by a hash and kept as a bucketed table, so that three passes over the texts shuffle them once.

Defined results: a null text is empty. Rows with a null doc_id are kept whole and remove nothing, as they have no order.
Rows with equal doc_id are one document to others and remove nothing from each other. Documents shorter than SPAN bytes
stay. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _forget, durable, shared_dir

SPAN, GRAM = 50, 20
#: Window starts that are hashed at once, and the bits of a place among them.
BLOCK, PLACE_BITS = 1 << 15, 16
#: Text bytes for each slice, trigger bucket and file of the table.
SLICE_BYTES, BUCKET_BYTES, FILE_BYTES = 4 << 20, 8 << 20, 16 << 20
#: Phrases of a trigger in one slice, and sent in all, from which it is split.
MOST, CROWD = 4, 4096
#: Phrases that are ordered at once, but for those of one trigger.
ORDERED = 4000

MANY = np.uint32(0xFFFFFFFF)
#: Added to an answer where a smaller document has the phrase, and what stands for that document.
SMALLER, LEAST = 4, np.iinfo(np.int64).min
PLACE = np.uint64((1 << PLACE_BITS) - 1)
PRIME = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME ** i and its inverse, modulo 2 ** 64, for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, p, np.uint64))]) for p in (PRIME, pow(PRIME, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP
    return h ^ (h >> np.uint64(29))


@dataclass
class Phrases:
    """Phrases of a block: first and last string start, trigger place, row of the document, hashes; all places are absolute."""

    first: np.ndarray
    last: np.ndarray
    trigger: np.ndarray
    row: np.ndarray
    gram: np.ndarray
    body: np.ndarray
    base: int
    sums: np.ndarray

    def of(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """Hashes of the strings that start at places within the block."""
        return _hash(self.sums, starts - self.base, sizes)


def _hash(sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    inverse = _powers(len(sums))[1]
    return mix((sums[starts + sizes] - sums[starts]) * inverse[starts] + np.asarray(sizes, np.uint64) * STEP)


def parse(data: np.ndarray, offsets: np.ndarray) -> Iterator[Phrases]:
    """The phrases of documents that lie end to end in data, block by block."""
    for base in range(0, max(0, len(data) - SPAN + 1), BLOCK):
        part = data[base : base + BLOCK + SPAN - 1]
        powers, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        places = np.arange(len(part) - GRAM + 1, dtype=np.uint64)
        hashes = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(places)])
        least = (hashes & ~PLACE) | places
        width = 1
        while 2 * width <= SPAN - GRAM + 1:  # minima over 2, 4, 8, 16 places, then over all
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = SPAN - GRAM + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        trigger = (least & PLACE).astype(np.int64)
        starts = np.arange(len(trigger))
        low, high = np.searchsorted(offsets, [base, base + len(starts)], side="right") - [1, 0]
        cuts = np.clip(offsets[low : high + 1] - base, 0, len(starts))
        row = np.repeat(np.arange(low, low + len(cuts) - 1), np.diff(cuts))
        inside = base + starts + SPAN <= offsets[row + 1]
        starts, trigger, row = starts[inside], trigger[inside], row[inside]
        if not len(starts):
            continue
        new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (np.diff(starts) != 1)]))
        first, last, at = starts[new], starts[np.append(new[1:], len(starts)) - 1], trigger[new]
        yield Phrases(base + first, base + last, base + at, row[new], hashes[at], _hash(sums, first, last - first + SPAN), base, sums)


def rank_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's rank among the distinct rows (bytes, compared lexicographically), and the places of the first of each."""
    columns = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order = np.lexsort(columns.T[::-1])
    ordered = columns[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)]) if len(rows) else np.zeros(0, bool)
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def order_block(data: np.ndarray, begin: np.ndarray, size: np.ndarray, trigger: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each phrase, the bits of its strings (bit i: the one at offset i) that a phrase of a smaller document also has.

    data holds the phrases' bytes; begin, size: where each lies; trigger: its trigger's offset within it.
    """
    pad = np.concatenate([data, np.zeros(2 * SPAN + GRAM, np.uint8)])
    across = np.arange(SPAN)
    left = pad[begin[:, None] + across]
    left[across >= (trigger + GRAM)[:, None]] = 0
    right = pad[(begin + trigger)[:, None] + across]
    right[across >= (size - trigger)[:, None]] = 0
    # the dictionary: distinct left halves and all their suffixes that hold the trigger
    whole, distinct = rank_rows(np.concatenate([left, (trigger + GRAM).astype(np.uint8)[:, None]], 1))
    counts = trigger[distinct] + 1
    owner = np.repeat(np.arange(len(distinct)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    wide = np.pad(left[distinct], ((0, 0), (0, SPAN)))
    suffix = np.lib.stride_tricks.sliding_window_view(wide, SPAN, axis=1)[owner, offset]
    length = (trigger[distinct][owner] + GRAM - offset).astype(np.uint8)
    suffix_rank, _ = rank_rows(np.concatenate([suffix, length[:, None]], 1))
    place_of = np.cumsum(counts) - counts
    # the parse: a left half, then a right half
    right_rank, _ = rank_rows(right)
    strings = size - SPAN + 1
    phrase = np.repeat(np.arange(len(size)), strings)
    at = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    by_left = suffix_rank[place_of[whole[phrase]] + at]
    order = np.lexsort((doc[phrase], right_rank[phrase], by_left))
    p, a = phrase[order], at[order]
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 18):
        j = slice(i, min(len(order), i + (1 << 18)))
        k = slice(j.start - 1, j.stop - 1)
        unlike = right[p[k]] != right[p[j]]
        common = np.where(unlike.any(1), unlike.argmax(1), SPAN)
        # of the right half, the trigger and what the left suffix leaves of the string
        same[j] = (by_left[order][k] == by_left[order][j]) & (common >= SPAN + GRAM - (trigger[p[j]] + GRAM - a[j]))
    starts = np.flatnonzero(~same)
    smallest = np.minimum.reduceat(doc[p], starts) if len(starts) else np.zeros(0, np.int64)
    repeated = smallest[np.cumsum(~same) - 1] < doc[p]
    return np.bincount(p[repeated], np.ldexp(1.0, a[repeated]), len(size)).astype(np.uint64)


def _join(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each row's begin."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts, sizes = [], [np.zeros(1, np.int64)]
    for chunk in chunks:
        chunk = chunk.cast(pa.large_binary()).fill_null(b"")
        if len(chunk):
            _, where, held = chunk.buffers()
            o = np.frombuffer(where, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
            sizes.append(np.diff(o))
            if o[-1] > o[0]:
                parts.append(np.frombuffer(held, np.uint8)[o[0] : o[-1]])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.cumsum(np.concatenate(sizes))


def _ids(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids as integers, and which of them are not null."""
    ok = np.asarray(column.is_valid().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.is_valid().to_numpy(), bool)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(column, pa.Array) else column.fill_null(0).to_numpy().astype(np.int64), ok


def _key(gram: np.ndarray, body: np.ndarray, buckets: int) -> np.ndarray:
    """One number for a phrase: its trigger's and its own hash (32 bits each), moved by the bucket."""
    return ((gram & np.uint64(0xFFFFFFFF)) << np.uint64(32)) + (body & np.uint64(0xFFFFFFFF)) + _bucket(gram, buckets).astype(np.uint64) * STEP


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _by(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of group and the places where it stands."""
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(group[places[0]]), places


def _sent(blocks: Iterable[Phrases], ids: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a slice sends: trigger, phrase (MANY for a trigger with more than MOST), document, and whether it is the smallest that has it here.

    It depends on the slice's documents alone, so that a slice can work out again what it has sent, in which order.
    """
    found = [(p.gram[k], (p.body[k] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ids[p.row[k]]) for p in blocks for k in [ok[p.row]]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
    gram, body, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((doc, body, gram))
    gram, body, doc = gram[order], body[order], doc[order]
    if not len(gram):
        return gram, body, doc, np.zeros(0, bool)
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (body[1:] != body[:-1])])
    start = np.flatnonzero(new)
    g, b, lo, hi = gram[start], body[start], doc[start], doc[np.append(start[1:], len(doc)) - 1]
    groups = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    sizes = np.diff(np.append(groups, len(g)))
    many = np.repeat(sizes > MOST, sizes)
    crowd = groups[sizes > MOST]
    least, most = np.minimum.reduceat(lo, groups)[sizes > MOST], np.maximum.reduceat(hi, groups)[sizes > MOST]
    twice = ~many & (hi > lo)
    mark = np.full(len(crowd), MANY)
    own = np.concatenate([np.ones((~many).sum(), bool), np.zeros(twice.sum(), bool), np.ones(len(crowd), bool), np.zeros(len(crowd), bool)])
    return np.concatenate([g[~many], g[twice], g[crowd], g[crowd]]), np.concatenate([b[~many], b[twice], mark, mark]), np.concatenate([lo[~many], hi[twice], least, most]), own


def _sender(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Step 2: the distinct phrases of a slice, by trigger bucket, with the smallest document (and the largest, if another)."""

    def send(texts: pa.Table) -> pa.Table:
        data, offsets = _flat(texts.column("data"))
        g, b, doc, _ = _sent(parse(data, offsets), *_ids(texts.column("doc_id")))
        number = texts.column("slice")[0].as_py()
        cells = [(k, number, (g[at] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), b[at].astype("<u4").tobytes(), _pack(doc[at])) for k, at in _by(_bucket(g, buckets))] if len(g) else []
        columns = list(zip(*cells, strict=True)) or [()] * 5
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "slice", "g", "b", "doc"])

    return send


def _pack(doc: np.ndarray) -> bytes:
    """doc_ids in 4 bytes each if they all fit, else in 8."""
    return doc.astype("<u4" if len(doc) and doc.min() >= 0 and doc.max() < 1 << 32 else "<i8").tobytes()


def _unpack(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if len(packed) == 4 * n else "<i8").astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """For each slice a byte for each phrase it sent, in that order: 0 if no two documents share its trigger, else 1 settled, 2 in doubt, 3 split, and SMALLER more if a smaller document has the phrase.

    Neither keys nor documents go back. Where all of a corpus is repeated, they would outweigh the texts.
    """
    packed_g = table.column("g").to_pylist()
    sizes = np.array([len(x) // 4 for x in packed_g], np.int64)
    g, b = np.frombuffer(b"".join(packed_g), "<u4"), _join(table.column("b"), "<u4")
    doc = np.concatenate([_unpack(x, n) for x, n in zip(table.column("doc").to_pylist(), sizes.tolist(), strict=True)])
    order = np.lexsort((doc, b, g))
    g, b, doc = g[order], b[order], doc[order]
    groups = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    count = np.diff(np.append(groups, len(g)))
    shared = np.minimum.reduceat(doc, groups) < np.maximum.reduceat(doc, groups)
    phrases = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])]))
    of_group = np.repeat(np.arange(len(groups)), count)
    distinct = np.bincount(of_group[phrases], minlength=len(groups))
    split = (np.maximum.reduceat(b, groups) == MANY) | (count > CROWD)
    least = np.repeat(doc[phrases], np.diff(np.append(phrases, len(g))))
    told = np.where(split, 3, np.where(distinct > 1, 2, 1))[of_group] + SMALLER * (least < doc)
    codes = np.empty(len(g), np.uint8)
    codes[order] = np.where(shared[of_group], told, 0)
    key = np.asarray(table.column("bucket")[0].as_py(), "<i4").tobytes()
    ends = np.cumsum(sizes)
    return _answers([(number, 0, key, b"", codes[end - n : end].tobytes()) for number, n, end in zip(table.column("slice").to_pylist(), sizes.tolist(), ends.tolist(), strict=True)])


_ANSWER = "slice bigint, kind int, key binary, value binary, flag binary"


def _answers(rows: list[tuple[int, int, bytes, bytes, bytes]]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["slice", "kind", "key", "value", "flag"])


class _Lookup:
    """Sorted keys with values."""

    def __init__(self, key: np.ndarray, *values: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.values = key[order], [v[order] for v in values]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted keys there are, and their places."""
        at = np.minimum(np.searchsorted(self.key, wanted), max(0, len(self.key) - 1))
        return (self.key[at] == wanted) if len(self.key) else np.zeros(len(wanted), bool), at


class _Slice:
    """A slice's texts with what the buckets have answered."""

    def __init__(self, texts: pa.Table, answers: pa.Table, buckets: int):
        self.data, self.offsets = _flat(texts.column("data"))
        self.ids, self.ok = _ids(texts.column("doc_id"))
        self.buckets = buckets
        self.blocks = list(parse(self.data, self.offsets)) if len(answers) else []
        kind = answers.column("kind").to_numpy() if len(answers) else np.zeros(0, np.int32)
        told, ordered = (answers.filter(pa.array(kind == k)) for k in (0, 1))
        self.told = self._told(told)
        self.ordered = _Lookup(_join(ordered.column("key"), "<u8"), _join(ordered.column("value"), "<i8"))

    def _told(self, told: pa.Table) -> _Lookup:
        """By phrase: the smallest document known to have it (LEAST if that is in another slice), and 0 settled, 1 in doubt, 2 split."""
        g, b, doc, own = _sent(self.blocks, self.ids, self.ok)
        code = np.zeros(len(g), np.int64)
        codes = {int(np.frombuffer(k, "<i4")[0]): np.frombuffer(c, np.uint8) for k, c in zip(told.column("key").to_pylist(), told.column("flag").to_pylist(), strict=True)}
        for bucket, at in _by(_bucket(g, self.buckets)) if codes else ():
            code[at] = codes[bucket]
        # of a phrase sent twice, the smaller document tells
        keep = own & (code > 0)
        g, b, doc, code = g[keep], b[keep], doc[keep], code[keep]
        smaller, flag = code >= SMALLER, code % SMALLER - 1
        key = _key(g, np.where(flag == 2, MANY, b).astype(np.uint64), self.buckets)
        return _Lookup(key, np.where(smaller, LEAST, doc), flag.astype(np.uint8))

    def phrases(self) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of phrases with: document, key, smallest document of the phrase, and -1 unshared, else the answer's flag."""
        for p in self.blocks:
            doc = self.ids[p.row]
            key = _key(p.gram, p.body, self.buckets)
            known, at = self.told.find(key)
            crowded, _ = self.told.find(_key(p.gram, np.full(len(key), MANY, np.uint64), self.buckets))
            least, flag = (v[at] if len(v) else np.zeros(len(key), v.dtype) for v in self.told.values)
            flag = np.where(crowded, 2, np.where(known, flag.astype(np.int64), -1))
            flag[~self.ok[p.row]] = -1
            yield p, doc, key, least, flag

    def split(self, p: Phrases, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of split triggers, every string: start, hash, document, offset of the trigger."""
        chosen = np.flatnonzero(flag == 2)
        sizes = (p.last - p.first + 1)[chosen]
        of = np.repeat(chosen, sizes)
        start = p.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return start, p.of(start, SPAN), self.ids[p.row[of]], p.trigger[of] - start


def _doubts(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Step 3: the bytes of the phrases in doubt, each from the smallest document that has it, and of split triggers' strings."""

    def emit(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(texts) and len(answers):
            s = _Slice(texts, answers, buckets)
            number = texts.column("slice")[0].as_py()
            phrases: list[tuple[np.ndarray, ...]] = []
            strings: list[tuple[np.ndarray, ...]] = []
            for p, doc, key, least, flag in s.phrases():
                own = np.flatnonzero((flag == 1) & (least == doc))
                phrases.append((key[own], doc[own], p.first[own], (p.last - p.first + SPAN)[own], (p.trigger - p.first)[own], _bucket(p.gram[own], buckets)))
                start, h, d, t = s.split(p, flag)
                strings.append((h, d, start, np.full(len(h), SPAN), t, (h % np.uint64(buckets)).astype(np.int64)))
            for kind, found in enumerate((phrases, strings)):
                if not found:
                    continue
                key, doc, start, size, t, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((doc, key))
                order = order[np.concatenate([[True], np.diff(key[order]) != 0])] if len(order) else order
                for b, at in _by(bucket[order]):
                    o = order[at]
                    places = np.repeat(start[o], size[o]) + np.arange(size[o].sum()) - np.repeat(np.cumsum(size[o]) - size[o], size[o])
                    rows.append((b, number, kind, key[o].astype("<u8").tobytes(), doc[o].astype("<i8").tobytes(), size[o].astype(np.uint8).tobytes(), t[o].astype(np.uint8).tobytes(), s.data[places].tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "slice", "kind", "key", "doc", "size", "at", "bytes"])

    return emit


_DOUBT = "bucket int, slice bigint, kind int, key binary, doc binary, size binary, at binary, bytes binary"


def _orders(table: pa.Table) -> pa.Table:
    """Steps 3 and 4: for each slice, the phrases in doubt with the bits of their repeated strings, and the repeated strings."""
    rows: list[tuple[int, int, bytes, bytes, bytes]] = []
    number = np.asarray(table.column("bucket")[0].as_py(), np.uint64)
    for kind in (0, 1):
        part = table.filter(pa.array(table.column("kind").to_numpy() == kind))
        if not len(part):
            continue
        key, doc, size, at = _join(part.column("key"), "<u8"), _join(part.column("doc"), "<i8"), _join(part.column("size"), np.uint8).astype(np.int64), _join(part.column("at"), np.uint8).astype(np.int64)
        data = _join(part.column("bytes"), np.uint8)
        owner = np.repeat(part.column("slice").to_numpy(), [len(x) // 8 for x in part.column("key").to_pylist()])
        begin = np.cumsum(size) - size
        group = (key - number * STEP) >> np.uint64(32) if kind == 0 else key
        order = np.argsort(group, kind="stable")
        # blocks end between triggers
        ends = np.append(np.flatnonzero(np.diff(group[order]) != 0) + 1, len(order))
        done, bits = 0, np.zeros(len(key), np.uint64)
        while done < len(order):
            stop = int(ends[min(len(ends) - 1, np.searchsorted(ends, done + ORDERED))])
            o = order[done:stop]
            bits[o] = order_block(data, begin[o], size[o], at[o], doc[o])
            done = stop
        hit = np.flatnonzero(bits)
        rows += [(s, 1, key[hit[w]].astype("<u8").tobytes(), bits[hit[w]].astype("<i8").tobytes(), b"") for s, w in _by(owner[hit])]
    return _answers(rows)


def _remover(buckets: int, keep_text: bool, id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        s = _Slice(texts, answers, buckets)
        n = len(s.data)
        edges = np.zeros(n + 1, np.int64)
        found, strings = [], []
        if len(answers):
            for p, doc, key, least, flag in s.phrases():
                gone = (flag >= 0) & (flag < 2) & (least < doc)
                np.add.at(edges, p.first[gone], 1)
                np.add.at(edges, p.last[gone] + SPAN, -1)
                doubt = np.flatnonzero((flag == 1) & (least == doc))
                there, at = s.ordered.find(key[doubt])
                if there.any():
                    doubt, bits = doubt[there], s.ordered.values[0][at[there]]
                    for i in range(SPAN - GRAM + 1):
                        on = doubt[(bits >> i) & 1 == 1]
                        found.append(p.first[on] + i)
                strings.append(s.split(p, flag)[:3])
        if strings:
            start, h, doc = (np.concatenate(x) for x in zip(*strings, strict=True))
            repeated, _ = s.ordered.find(h)
            order = np.lexsort((doc, h))
            new = np.concatenate([[True], np.diff(h[order]) != 0]) if len(h) else np.zeros(0, bool)
            first = np.empty(len(h), np.int64)
            first[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else 0
            found.append(start[repeated | (doc > first)])
        for starts in found:
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + SPAN, -1)
        covered = np.cumsum(edges[:-1]) > 0
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        heads = s.offsets[:-1][s.offsets[:-1] < n]
        begins[heads] = covered[heads]
        stops = covered.copy()
        stops[:-1] &= ~covered[1:]
        tails = s.offsets[1:][s.offsets[1:] > 0] - 1
        stops[tails] = covered[tails]
        from_, upto = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        row = np.searchsorted(s.offsets, from_, side="right") - 1
        size = np.diff(s.offsets)
        removed = np.bincount(row, upto - from_, len(size)).astype(np.int64)
        spans = np.bincount(row, minlength=len(size))
        digests, kept = [], []
        for i, (a, b) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
            rest = s.data[a:b]
            rest = (rest[~covered[a:b]] if removed[i] else rest).tobytes()
            digests.append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                kept.append(rest)
        where = pa.StructArray.from_arrays([pa.array(from_ - s.offsets[row], pa.int64()), pa.array(upto - s.offsets[row], pa.int64())], names=["start", "stop"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans)]), pa.int32()), where)
        columns = [texts.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed), pa.array(spans, pa.int64()), lists, pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
        return pa.table([*columns, pa.array(kept, pa.binary())] if keep_text else columns, names=[*names, "kept"] if keep_text else names)

    return remove


def _bucketed(df: DataFrame, files: int, key: str) -> DataFrame:
    """df as a table of the shared folder, dealt to files by key; joins on key read it without a shuffle."""
    spark, name = df.sparkSession, f"lakeglass_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lakeglass/{name}"
    df.repartition(files, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(files, key).sortBy(key).saveAsTable(name)
    atexit.register(_forget, spark, path)
    return spark.table(name)


def substring_dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of start and stop), kept_sha256 and, if keep_text, kept (the rest, as bytes)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("data"))
    size = slim.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    slices, buckets, files = (max(1, -(-size // x)) for x in (SLICE_BYTES, BUCKET_BYTES, FILE_BYTES))
    dealt = slim.withColumn("slice", F.pmod(F.xxhash64("doc_id", "data"), F.lit(slices)).cast("long")).select("slice", "doc_id", "data")
    texts = _bucketed(dealt, files, "slice")
    sent = texts.groupBy("slice").applyInArrow(_sender(buckets), "bucket int, slice bigint, g binary, b binary, doc binary")
    answers = durable(sent.groupBy("bucket").applyInArrow(_answer, _ANSWER))
    doubts = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_doubts(buckets), _DOUBT)
    ordered = durable(doubts.groupBy("bucket").applyInArrow(_orders, _ANSWER))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string" + (", kept binary" if keep_text else "")
    return texts.groupBy("slice").cogroup(answers.unionByName(ordered).groupBy("slice")).applyInArrow(_remover(buckets, keep_text, pa.int64()), schema)
