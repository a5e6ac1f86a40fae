"""Language identification: a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into fixed-length windows. Filters of several widths run over a window's byte embeddings, each
filter's largest activation is kept (max pooling), and a softmax over those gives the window's languages; a document's
probabilities are the geometric mean of its windows', weighted by their bytes. A filter over embedded bytes is a sum of one
table entry per tap, so a trained network is applied as table look-ups: neighbouring taps share a table of byte pairs.

Fitted by gradient descent on windows of a bounded sample (about per_language documents of each language), then broadcast;
applied to all windows of whole texts, in batches, where the rows are read.

Defined results: 'und' with score 0 if a text is null, empty or has no letter, or if nothing can be learned. Null languages are
not learned from. With one language in the sample, that one is predicted with score 1. Each row is predicted by its
text alone: repeated rows get repeated results, a row with a null doc_id its own (and counts as not held out). Of languages that are equally likely the first in
alphabetical order is taken. Extra columns are left out, whatever their names. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc

WIDTHS, FILTERS, DIM, WINDOW = (2, 3, 4), 8, 8, 192
#: Bound of the training sample: about this many documents of each language, and windows from each.
PER_LANGUAGE, TRAIN_WINDOWS, MAX_TRAIN_CHARS = 600, 4, 60_000
#: Windows that one batch holds.
BATCH = 2048
LETTER = regex.compile(r"\p{L}")


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes in rows of `size`; the last row is the text's last `size` bytes, short texts are filled with spaces."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= size:
        return np.concatenate([a, np.full(size - len(a), 32, np.uint8)])[None]
    whole = a[: len(a) // size * size].reshape(-1, size)
    return whole if len(a) % size == 0 else np.concatenate([whole, a[-size:][None]])


def train(texts: list[str], langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> tuple[list[str], dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Languages, for each width the tap tables (width, 256, filters), output weights and bias. Fitted with Adam."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    x, y = [], []
    for t, lang in zip(texts, langs, strict=True):
        data = t.encode()
        if LETTER.search(t):
            rows = windows(data)
            rows = rows[rng.permutation(len(rows))[:TRAIN_WINDOWS]]
            x.append(rows)
            y += [names.index(lang)] * len(rows)
    emb = rng.normal(0, 0.5, (256, DIM))
    par = {"emb": emb, "out": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))), "bias": np.zeros(len(names))}
    par |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)) for w in WIDTHS}
    if not x or len(names) < 2:
        return names, {w: np.zeros((w, 256, FILTERS), np.float32) for w in WIDTHS}, par["out"].astype(np.float32) * 0, par["bias"].astype(np.float32)
    data, target = np.concatenate(x), np.array(y)
    m, v, t = {k: np.zeros_like(a) for k, a in par.items()}, {k: np.zeros_like(a) for k, a in par.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            rows, gold = data[order[at : at + batch]], target[order[at : at + batch]]
            e, n, pooled, kept = par["emb"][rows], len(rows), [], []
            for w in WIDTHS:
                taps = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * DIM)
                act = taps @ par[f"f{w}"]
                best = act.argmax(1)
                pooled.append(np.take_along_axis(act, best[:, None], 1)[:, 0])
                kept.append((taps, best))
            h = np.concatenate(pooled, 1)
            z = np.tanh(h)
            logits = z @ par["out"] + par["bias"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), gold] -= 1
            p /= n
            grad = {"out": z.T @ p, "bias": p.sum(0), "emb": np.zeros_like(par["emb"])}
            dh = (p @ par["out"].T) * (1 - z * z)
            for i, w in enumerate(WIDTHS):
                taps, best = kept[i]
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                chosen = taps[np.arange(n)[:, None], best]  # n, filters, taps
                grad[f"f{w}"] = np.einsum("nfk,nf->kf", chosen, d)
                back = np.einsum("kf,nf->nfk", par[f"f{w}"], d).reshape(n, FILTERS, w, DIM)
                for k in range(w):
                    np.add.at(grad["emb"], np.take_along_axis(rows, best + k, 1), back[:, :, k])
            t += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                par[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    tables = {w: np.stack([par["emb"] @ par[f"f{w}"].reshape(w, DIM, FILTERS)[k] for k in range(w)]).astype(np.float32) for w in WIDTHS}
    return names, tables, par["out"].astype(np.float32), par["bias"].astype(np.float32)


class Network:
    """A trained network over tables: taps are summed by pairs of bytes."""

    def __init__(self, names: list[str], tables: dict[int, np.ndarray], out: np.ndarray, bias: np.ndarray):
        self.names, self.out, self.bias, self.tables = names, out, bias, []
        for w, t in tables.items():
            pairs = [(k, (t[k][:, None] + t[k + 1][None]).reshape(65536, -1)) for k in range(0, w - 1, 2)]
            self.tables.append((w, pairs, t[w - 1] if w % 2 else None))

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """Log-probabilities of each window's languages."""
        pair = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        pooled = []
        for w, pairs, last in self.tables:
            n = rows.shape[1] - w + 1
            act = pairs[0][1][pair[:, :n]]
            for k, t in pairs[1:]:
                act += t[pair[:, k : k + n]]
            if last is not None:
                act += last[rows[:, w - 1 : w - 1 + n]]
            pooled.append(act.max(1))
        z = np.tanh(np.concatenate(pooled, 1)) @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.names:
            return found
        sums = np.zeros((len(texts), len(self.names)))
        count = np.zeros(len(texts))
        rows: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if rows:
                whose = np.concatenate(owner)
                data = np.concatenate(rows)
                for at in range(0, len(data), BATCH // 8):  # small enough for the caches
                    part = whose[at : at + BATCH // 8]
                    np.add.at(sums, part, self.logits(data[at : at + BATCH // 8]))
                    np.add.at(count, part, 1)
                rows.clear()
                owner.clear()
            waiting = 0

        for i, text in enumerate(texts):
            if text and LETTER.search(text):
                w = windows(text.encode())
                for at in range(0, len(w), BATCH):
                    rows.append(w[at : at + BATCH])
                    owner.append(np.full(len(rows[-1]), i))
                    waiting += len(rows[-1])
                    if waiting >= BATCH:
                        flush()
        flush()
        for i in np.flatnonzero(count):
            mean = sums[i] / count[i]
            p = np.exp(mean - mean.max())
            p /= p.sum()
            found[i] = (self.names[int(p.argmax())], float(p.max()))
        return found


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE, modulus: int = 3, left_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from documents whose crc32(doc_id) mod modulus is not left_out."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (crc("doc_id", modulus) != left_out))
    # ids are picked first, without texts; about per_language of each language, so the broadcast side is bounded
    picked = F.broadcast(bounded_sample(known, "doc_id", "lang", per_language).distinct())
    rows = docs.select("doc_id", "text").where(F.length("text") <= MAX_TRAIN_CHARS).join(picked, "doc_id").select("doc_id", "text", "lang").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    shared = docs.sparkSession.sparkContext.broadcast(train([r["text"] for r in rows], [r["lang"] for r in rows]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(*shared.value)
        for batch in batches:
            lang: list[str] = []
            score: list[float] = []
            for at in range(0, len(batch), 64):
                got = network.predict(batch.column(1).slice(at, 64).to_pylist())
                lang += [x for x, _ in got]
                score += [x for _, x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    said = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return said.select("doc_id", F.coalesce(crc("doc_id", modulus) == left_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
