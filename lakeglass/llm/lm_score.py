"""Language-model scores: a causal self-attention model in numpy over subword ids, with corpus-wide word counts.

Tokens are the words of a text (A-Z in lower case) and one end. The model factors a token's probability into its class and the
token within the class: P(token | before) = P(class | before) * (c + 1) / (sum of (c' + 1) over the class's known tokens + 1).

- A word's subwords, all of them, are found by greedy longest match in a public vocabulary. Words of equal first subword share a class (the
  CLASSES - 2 most frequent ones; the others share one, the end has its own).
- P(class | before) comes from one causal attention block over the words before, each embedded as the sum of its subwords' vectors,
  over the square root of their number. Texts are cut into windows of CONTEXT places that overlap by OVERLAP; a window scores the
  places that the one before it has not, so every token is scored once, windows in batches under a causal mask.
- The network is fitted on every token of every document that may be learned from. It starts from the classes' shares. Documents are dealt by
  a hash to ROUNDS rounds, and within one to shards of some SHARD_BYTES. The shards of a round train from common weights by Adam, once over their
  windows, and the weights are averaged by the shards' tokens.
- The counts c cover all documents that may be learned from. Each batch of documents is turned into one row: its distinct
  words' hashes in order and, by document, places in that list. The hashes are dealt to buckets by their leading bits, a slice of a batch
  being one row; a bucket adds up and sends each slice its counts back. A word that every document has is one number in a slice of each batch, so no
  key is hot, and buckets are as many as the slices' lengths ask for.

Defined results: null, empty and blank texts are the end alone. Words are told apart by 64-bit hashes of their bytes. Without
documents to learn from, all counts are 0 and the class probabilities those of the untrained network. Rows are scored one by one: repeated
rows give repeated results and count each time, and rows with a null doc_id are learned from (held_out is false). Ties among first subwords go to the smaller id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import load_ranks
from .common import crc, durable

DIM, CONTEXT, OVERLAP, CLASSES, BUCKETS = 16, 32, 8, 64, 8192
SHARD_BYTES, ROUNDS, WEIGHTS_ROW = 16 << 20, 2, 4096
#: Hashes of a bucket of the count.
BUCKET_WORDS = 1_000_000
#: Documents go into a batch row until their texts have this many bytes.
BATCH_BYTES = 6 << 20
#: Batch rows in a file.
FILE_BATCHES = 4
#: Words that a worker remembers.
REMEMBERED = 300_000
END, OTHER, PIECE_BYTES = 0, 1, 10
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def subwords(word: bytes, ranks: dict[bytes, int], most: int | None = None) -> list[int]:
    """Ids of a word's subwords, or its first ones, by greedy longest match (the vocabulary has every single byte)."""
    ids, at = [], 0
    while at < len(word) and len(ids) != most:
        for size in range(min(PIECE_BYTES, len(word) - at), 0, -1):
            if (found := ranks.get(word[at : at + size])) is not None:
                ids.append(found)
                at += size
                break
    return ids


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
    par = {"piece": draw(BUCKETS, DIM, scale=0.3), "cls": draw(CLASSES, DIM, scale=0.3), "pos": draw(CONTEXT, DIM), "start": draw(DIM)}
    par |= {k: draw(DIM, DIM, scale=0.25) for k in ("q", "k", "v", "hid")}
    return par | {"out": draw(DIM, CLASSES), "bias": np.zeros(CLASSES, np.float32)}


MASK = np.triu(np.full((CONTEXT, CONTEXT), -1e9, np.float32), 1)


def forward(x: np.ndarray, par: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Class logits after each place of windows x (windows, CONTEXT, DIM), under the causal mask."""
    flat = lambda z, w: (z.reshape(-1, z.shape[-1]) @ w).reshape(*z.shape[:-1], w.shape[1])  # noqa: E731  one product, not one for each window
    q, k, v = (flat(x, par[n]) for n in ("q", "k", "v"))
    s = q @ k.transpose(0, 2, 1)
    s *= np.float32(1 / np.sqrt(DIM))
    np.minimum(s, 60, out=s)  # far above any fitted score; exp() of it is finite
    s += MASK
    np.exp(s, out=s)
    s /= s.sum(2, keepdims=True)
    a = x + s @ v
    h = np.tanh(flat(a, par["hid"]))
    return flat(h, par["out"]) + par["bias"], h, a, s, q, k, v


def cut(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows over n places: their first places, and the first place within each that it scores."""
    starts = np.arange(0, max(1, n - OVERLAP), CONTEXT - OVERLAP)
    return starts, np.where(starts == 0, 0, OVERLAP)


def embed(pieces: list[list[int]], par: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's vector from its subwords (one at least), and the flat buckets, their words and scales."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((j for i in pieces for j in i), np.int64, int(sizes.sum())) % BUCKETS
    scale = (1 / np.sqrt(sizes)).astype(np.float32)
    total = np.add.reduceat(par["piece"][flat], np.cumsum(sizes) - sizes, axis=0) if len(pieces) else np.zeros((0, DIM), np.float32)
    return (total * scale[:, None]).astype(np.float32), flat, np.repeat(np.arange(len(pieces)), sizes), scale


class _Places(dict):
    """Place of each word; a new word gets the next one and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


def lay_out(docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Documents in one row of places, each a start and then its words; first place, skipped places, document and end of every window."""
    lengths = np.array([len(d) + 1 for d in docs])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    first, skip, whose = [], [], []
    for i, (b, n) in enumerate(zip(begin, lengths, strict=True)):
        s, k = cut(int(n))
        first.append(s + b)
        skip.append(k)
        whose.append(np.full(len(s), i))
    whose = np.concatenate(whose)
    return lengths, begin, np.concatenate(first), np.concatenate(skip), whose, (begin + lengths)[whose]


def _sums(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group (0 to n - 1)."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(rows):
        order = np.argsort(group, kind="stable")
        found, starts = np.unique(group[order], return_index=True)
        out[found] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def train_shard(texts: list[bytes], ranks: dict[bytes, int], classes: dict[int, int], par: dict[str, np.ndarray], rate: float, batch: int = 128) -> tuple[dict[str, np.ndarray], int]:
    """Adam over all windows of a shard's texts, once, each token a target once; and the number of tokens."""
    place = _Places()
    docs = []
    for t in texts:
        w = t.translate(LOWER).split()
        docs.append(np.fromiter(map(place.__getitem__, w), np.int64, len(w)))
    split = [subwords(w, ranks) for w in place.new]
    word_cls = np.array([classes.get(ids[0], OTHER) for ids in split], np.int64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    pieces, at_piece = np.fromiter((j for i in split for j in i), np.int64, int(sizes.sum())) % BUCKETS, np.cumsum(sizes) - sizes
    lengths, begin, first, skip, _, end = lay_out(docs)
    word, gold = np.full(lengths.sum() + CONTEXT, -1), np.zeros(lengths.sum() + CONTEXT, np.int64)
    for b, d in zip(begin, docs, strict=True):
        word[b + 1 : b + 1 + len(d)] = d
        gold[b : b + len(d)] = word_cls[d]
        gold[b + len(d)] = END
    starting = np.zeros(len(word), bool)
    starting[begin] = True
    par = {k: a.copy() for k, a in par.items()}
    m, v2 = {k: np.zeros_like(a) for k, a in par.items()}, {k: np.zeros_like(a) for k, a in par.items()}
    scale, wide = np.float32(1 / np.sqrt(DIM)), lambda z: z.reshape(-1, z.shape[-1])
    order = np.random.default_rng(3).permutation(len(first))
    steps = -(-len(order) // batch)
    for t in range(1, steps + 1):
        f = order[(t - 1) * batch : t * batch]
        places = first[f][:, None] + np.arange(CONTEXT)
        held = places < end[f][:, None]
        real = held & (np.arange(CONTEXT) >= skip[f][:, None])
        here, begins = np.where(held, word[places], -1), held & starting[places]
        read = here >= 0
        known, index = np.unique(here[read], return_inverse=True)
        # the subwords of the batch's distinct words, one after another
        n = sizes[known]
        owner = np.repeat(np.arange(len(known)), n)
        flat = pieces[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at_piece[known], n)]
        shrink = (1 / np.sqrt(n)).astype(np.float32)[:, None]
        x = np.zeros((*here.shape, DIM), np.float32)
        if len(known):
            vectors = np.add.reduceat(par["piece"][flat], np.cumsum(n) - n, axis=0) * shrink + par["cls"][word_cls[known]]
            x[read] = vectors[index]
        x[begins] = par["start"]
        x += par["pos"]
        logits, h, a, s, q, k, v = forward(x, par)
        prob = np.exp(logits - logits.max(2, keepdims=True))
        prob /= prob.sum(2, keepdims=True)
        wide(prob)[np.arange(here.size), gold[places].ravel()] -= 1
        prob *= real[..., None] / np.float32(max(1, real.sum()))
        back = (wide(prob) @ par["out"].T) * (1 - wide(h) ** 2)
        da = (back @ par["hid"].T).reshape(x.shape)
        g = {"out": wide(h).T @ wide(prob), "bias": prob.sum((0, 1)), "hid": wide(a).T @ back}
        ds = da @ v.transpose(0, 2, 1)
        ds = s * (ds - (ds * s).sum(2, keepdims=True)) * scale
        dx = da.copy()
        for name, d in (("q", ds @ k), ("k", ds.transpose(0, 2, 1) @ q), ("v", s.transpose(0, 2, 1) @ da)):
            g[name] = wide(x).T @ wide(d)
            dx += (wide(d) @ par[name].T).reshape(x.shape)
        g["pos"], g["start"] = dx.sum(0), dx[begins].sum(0)
        of_word = _sums(dx[read], index, len(known))
        g["cls"], g["piece"] = _sums(of_word, word_cls[known], CLASSES), _sums((of_word * shrink)[owner], flat, BUCKETS)
        step = rate * (1 - 0.8 * t / steps)
        for name, d in g.items():
            m[name] += 0.1 * (d - m[name])
            v2[name] += 0.01 * (d * d - v2[name])
            par[name] = (par[name] - step * (m[name] / (1 - 0.9**t)) / (np.sqrt(v2[name] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return par, int(lengths.sum())


class Reader:
    """Turns words into hashes, classes and input vectors; remembers them by word."""

    def __init__(self, ranks: dict[bytes, int], classes: dict[int, int], par: dict[str, np.ndarray]):
        self.ranks, self.classes, self.par = ranks, classes, par
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.hash, self.cls = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.vec = np.zeros((0, DIM), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        low = [w.translate(LOWER) for w in words]
        split = [subwords(w, self.ranks) for w in low]
        cls = np.array([self.classes.get(ids[0], OTHER) for ids in split], np.int64)
        self.hash = np.concatenate([self.hash, np.fromiter((xxhash.xxh64_intdigest(w, 5) for w in low), np.uint64, len(low))])
        self.cls = np.concatenate([self.cls, cls])
        self.vec = np.concatenate([self.vec, embed(split, self.par)[0] + self.par["cls"][cls]])

    def read(self, texts: list[bytes]) -> list[np.ndarray]:
        """Places of each text's words."""
        if len(self.place) > REMEMBERED:
            self._forget()
        split = [t.split() for t in texts]  # splits at the six separators, which are all that bytes knows
        places = [np.fromiter(map(self.place.__getitem__, w), np.int64, len(w)) for w in split]
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        return places

    def class_scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each document's classes, end included."""
        par = self.par
        lengths, begin, first, skip, whose, ends = lay_out(docs)
        x, y = np.empty((lengths.sum() + CONTEXT, DIM), np.float32), np.zeros(lengths.sum() + CONTEXT, np.int64)
        for b, d in zip(begin, docs, strict=True):
            x[b] = par["start"]
            x[b + 1 : b + 1 + len(d)] = self.vec[d]
            y[b : b + len(d)] = self.cls[d]
            y[b + len(d)] = END
        x[lengths.sum() :] = 0
        total = np.zeros(len(docs))
        for at in range(0, len(first), 256):
            f, k, o = first[at : at + 256], skip[at : at + 256], whose[at : at + 256]
            places = f[:, None] + np.arange(CONTEXT)
            logits = forward(x[places] + par["pos"], par)[0]
            np.minimum(logits, 80, out=logits)  # tanh keeps them small
            gold = np.take_along_axis(logits, y[places][..., None], 2)[..., 0] - np.log(np.exp(logits).sum(2))
            counted = (np.arange(CONTEXT) >= k[:, None]) & (places < ends[at : at + 256, None])
            total += np.bincount(o, np.where(counted, gold, 0).sum(1), len(docs))
        return total / np.log(10)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _trainer(shared: Broadcast, rate: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """A shard's weights, end to end, as rows of WEIGHTS_ROW of them times the shard's tokens, with those tokens."""

    def train(key: tuple, shard: pa.Table) -> pa.Table:
        ranks, classes, par = shared.value
        # in an order that no partitioning changes
        texts = sorted((x or b"" for x in shard.column("text").cast(pa.binary()).to_pylist()), key=lambda x: xxhash.xxh64_intdigest(x, 77))
        new, tokens = train_shard(texts, ranks, classes, par, rate)
        flat = np.concatenate([new[k].ravel() for k in sorted(new)]).astype(np.float64) * tokens
        rows = [flat[i : i + WEIGHTS_ROW] for i in range(0, len(flat), WEIGHTS_ROW)]
        return pa.table({"shard": pa.array([key[0].as_py()] * len(rows), pa.int64()), "row": pa.array(range(len(rows)), pa.int32()), "tokens": pa.array([tokens] * len(rows), pa.int64()), "a": pa.array(rows, pa.list_(pa.float64()))})

    return train


def _add_weights(key: tuple, rows: pa.Table) -> pa.Table:
    """The mean of one row of weights over the shards."""
    rows = rows.sort_by([("shard", "ascending")])
    total = sum(x.values.to_numpy() for x in rows.column("a"))
    return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "a": pa.array([total / sum(rows.column("tokens").to_pylist())], pa.list_(pa.float64()))})


def _fit(learned: DataFrame, ranks: dict[bytes, int]) -> tuple[dict[int, int], dict[str, np.ndarray]]:
    """Classes and weights from all documents, in shards: only counts and weights come to the driver."""
    context = learned.sparkSession.sparkContext
    vocabulary = context.broadcast(ranks)

    def first_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                counts: Counter[bytes] = Counter()
                for t in _texts(batch.slice(at, 500), 0):
                    counts.update(t.translate(LOWER).split())
                if len(piece) > REMEMBERED:
                    piece.clear()
                found: Counter[int] = Counter()
                for word, n in counts.items():
                    if (p := piece.get(word)) is None:
                        p = piece[word] = subwords(word, vocabulary.value, 1)[0]
                    found[p] += n
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], names=["piece", "n"])

    counts = durable(learned.select("text").mapInArrow(first_pieces, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "piece").limit(CLASSES - 2).collect()
    classes = {r["piece"]: i + 2 for i, r in enumerate(top)}
    par = initial()
    # from the classes' shares, so that the network has only to learn what the words before say
    rows, size = learned.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    seen = np.ones(CLASSES)
    seen[2 : 2 + len(top)] += [r["n"] for r in top]
    seen[OTHER] += (counts.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in top)
    seen[END] += rows
    par["bias"] = np.log(seen / seen.sum()).astype(np.float32)
    shards = max(1, round((size or 0) / ROUNDS / SHARD_BYTES))
    dealt = learned.select("text", F.xxhash64(F.lit(77), "doc_id", "text").alias("hash"))
    for done in range(ROUNDS):
        shared = context.broadcast((ranks, classes, par))
        mine = dealt.where(F.pmod("hash", F.lit(ROUNDS)) == done).select(F.pmod(F.floor(F.col("hash") / ROUNDS), F.lit(shards)).alias("shard"), "text")
        trained = mine.groupBy("shard").applyInArrow(_trainer(shared, 0.01 / (1 + done)), "shard bigint, row int, tokens bigint, a array<double>")
        got = sorted(trained.groupBy("row").applyInArrow(_add_weights, "row int, a array<double>").collect(), key=lambda r: r["row"])
        if got:
            flat, at = np.concatenate([r["a"] for r in got]).astype(np.float32), 0
            for k in sorted(par):
                par[k], at = flat[at : at + par[k].size].reshape(par[k].shape), at + par[k].size
    return classes, par


def _slices(bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch's ordered hashes, and what goes with them, cut by their leading bits: batch, bucket, h, cls, seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                h = batch.column(1)[row].values.to_numpy().view(np.uint64)
                inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
                edges = np.concatenate([[0], np.searchsorted(h, inner), [len(h)]]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edges), batch.column(c)[row].values) for c in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * (1 << bits)), pa.array(np.arange(1 << bits)), *lists], names=["batch", "bucket", "h", "cls", "seen"])

    return run


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """batch, bucket, c (the corpus-wide count of each hash of the slice); and, as batch -1, the tokens and the distinct known words by class."""
    h, seen, cls = (np.concatenate(frame[c].to_numpy()) if len(frame) else np.zeros(0, np.int64) for c in ("h", "seen", "cls"))
    _, first, index = np.unique(h, return_index=True, return_inverse=True)
    counts = np.bincount(index, seen, len(first)).astype(np.int64)
    kinds = cls[first].astype(np.int64)
    sums = np.concatenate([np.bincount(kinds, counts, CLASSES), np.bincount(kinds, counts > 0, CLASSES)]).astype(np.int64)
    sizes = frame["h"].map(len).to_numpy()
    each = np.split(counts[index], np.cumsum(sizes)[:-1])
    return pd.DataFrame({"batch": [*frame["batch"], -1], "bucket": frame["bucket"].iloc[0], "c": [*each, sums]})


def lm_scores(docs: DataFrame, rank_path: str, modulus: int = 7, left_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    ranks = load_ranks(rank_path)
    context = docs.sparkSession.sparkContext
    marked = docs.select("doc_id", "text", F.coalesce(crc("doc_id", modulus) == left_out, F.lit(False)).alias("held_out"))
    learned = marked.where(~F.col("held_out"))
    classes, par = _fit(learned, ranks)
    shared = context.broadcast((ranks, classes, par))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, made = Reader(*shared.value), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts, at = _texts(batch, 2), 0
            while at < len(texts):
                size, stop = 0, at
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BATCH_BYTES):
                    size += len(texts[stop])
                    stop += 1
                places, scores = [], []
                for i in range(at, stop, 256):
                    if len(reader.place) > REMEMBERED and places:  # what is remembered can only go between rows
                        stop = i
                        break
                    got = reader.read(texts[i : min(stop, i + 256)])
                    places += got
                    scores.append(reader.class_scores(got))
                flat = np.concatenate(places)
                words, index = np.unique(flat, return_inverse=True)
                ranked = np.argsort(reader.hash[words], kind="stable")
                words, index = words[ranked], np.argsort(ranked)[index]
                sizes = np.array([len(x) for x in places])
                learn = ~np.array(batch.column(1).slice(at, stop - at).to_pylist(), bool)
                seen = np.bincount(index, np.repeat(learn, sizes), len(words)).astype(np.int64)
                made += 1
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                ids = batch.column(0).slice(at, stop - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) | made]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(~learn, pa.bool_()), one(sizes, pa.int32()), one(index.astype(np.int32), pa.int32()), one(np.concatenate(scores), pa.float64()), one(reader.hash[words].view(np.int64), pa.int64()), one(reader.cls[words].astype(np.int8), pa.int8()), one(seen.astype(np.int32), pa.int32())],
                    names=["batch", "doc_id", "held_out", "sizes", "places", "scores", "h", "cls", "seen"],
                )
                at = stop

    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = durable(marked.select("doc_id", "held_out", "text").mapInArrow(pack, f"batch bigint, doc_id array<{kind}>, held_out array<boolean>, sizes array<int>, places array<int>, scores array<double>, h array<bigint>, cls array<tinyint>, seen array<int>"), FILE_BATCHES)
    in_all = packed.agg(F.sum(F.size("h"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, in_all / BUCKET_WORDS)))))
    slices = packed.select("batch", "h", "cls", "seen").mapInArrow(_slices(bits), "batch bigint, bucket bigint, h array<bigint>, cls array<tinyint>, seen array<int>").where(F.size("h") > 0)
    counted = durable(slices.groupBy("bucket").applyInPandas(_add_up, "batch bigint, bucket bigint, c array<bigint>"))
    sums = {r["at"]: r["n"] for r in counted.where("batch = -1").select(F.posexplode("c").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()}  # two rows for each class
    by_class = {k: {"n": sums[k], "v": sums[CLASSES + k]} for k in range(CLASSES) if sums.get(k)}
    end_count = learned.count()
    size = lambda k: (by_class[k]["n"], by_class[k]["v"]) if k in by_class else (end_count, int(end_count > 0)) if k == END else (0, 0)
    train_tokens = sum(size(k)[0] for k in range(CLASSES))
    log_all = float(np.log10(sum(sum(size(k)) for k in range(CLASSES)) + 1))
    log_class = np.log10(np.array([sum(size(k)) + 1 for k in range(CLASSES)], float))

    def unpack(row: pa.Table, found: pa.Table) -> pa.Table:
        """In Arrow throughout: pandas would make large ids beside a null one into floats."""
        of_row = lambda name: row.column(name).combine_chunks().flatten()
        c = found.sort_by("bucket").column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False) if found.num_rows else np.zeros(0)
        sizes, places = of_row("sizes").to_numpy().astype(np.int64), of_row("places").to_numpy()
        whose = np.repeat(np.arange(len(sizes)), sizes)
        own = np.log10(c + 1.0)
        of_doc = lambda x: np.bincount(whose, x[places], len(sizes))
        plain = of_doc(own) + np.log10(end_count + 1)
        model = of_row("scores").to_numpy() + plain - of_doc(log_class[of_row("cls").to_numpy().astype(np.int64)]) - log_class[END]
        n_known = of_doc((c > 0).astype(float)) + (end_count > 0)
        columns = [of_row("doc_id"), of_row("held_out"), pa.array(sizes + 1), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(sizes), train_tokens, np.int64)), pa.array(plain - (sizes + 1) * log_all), pa.array(model)]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return packed.drop("h", "seen").groupBy("batch").cogroup(counted.where("batch >= 0").groupBy("batch")).applyInArrow(unpack, out)
