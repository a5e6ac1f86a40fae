"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the mean of the learned vectors of its features: hashed words, their character n-grams (3 to 5, with word
boundaries) and a marker for each word that repeats the one before it (the one word bigram whose identity matters here).
A softmax over that mean gives the probability of label 1. Because the mean and the output layer are linear, a word's
contribution to the logit is one number; a worker computes it once for each word it meets and remembers it.

The model is fitted on a bounded sample of labelled rows (about per_class of each label, chosen by a hash of the id) and
broadcast; its size is fixed by buckets x dim. Scoring runs where the rows are read, over whole texts.

Defined results: null, empty and blank texts have no features and get the score of the output layer's bias. Rows with a null
label are not learned from; a document labelled more than once counts as 1 if any label is 1. With no labels at all, or
only one class, every score is that class's share (0.5 without labels). Each row is scored by its text alone: repeated rows get repeated results, a row with a
null doc_id its own (it is not learned from, as it has no label). There are no ties to break. Extra columns are left out, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 12, 3, 5
#: Bound of the training sample: about this many rows of each label, none longer than MAX_TRAIN_CHARS.
PER_CLASS, MAX_TRAIN_CHARS = 2500, 60_000
REMEMBERED = 400_000
REPEAT = zlib.crc32(b"\x00repeat") % BUCKETS
BLANK = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def split_words(text: str) -> list[str]:
    """Words by the contract's six separators only (str.split() knows more)."""
    return [w for w in text.translate(BLANK).split(" ") if w]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character n-grams, and for each bucket the place of its word; all words at once."""
    sizes = np.array([len(w) + 2 for w in words])
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ids = [np.array([zlib.crc32(b"\x01" + w.encode("utf-8", "surrogatepass")) for w in words], np.uint64) % np.uint64(BUCKETS)]
    owners = [np.arange(len(words))]
    for n in range(SHORTEST, LONGEST + 1):
        size = len(points) - n + 1
        if size < 1:
            break
        h = points[:size] + np.uint64(n)
        for k in range(1, n):
            h = h * np.uint64(0x100000001B3) + points[k : k + size]
        inside = owner[:size] == owner[n - 1 :]
        h = h[inside] * np.uint64(0x9E3779B97F4A7C15)
        ids.append((h >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(owner[:size][inside])
    return np.concatenate(ids).astype(np.int64), np.concatenate(owners)


def doc_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and how often each occurs."""
    words = split_words(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, _ = word_features(words)
    return np.unique(np.concatenate([ids, np.full(sum(map(str.__eq__, words, words[1:])), REPEAT)]), return_counts=True)


def train(texts: list[str], labels: list[int], prior: float, epochs: int = 6, rate: float = 0.6, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's contribution to the logit of label 1 against label 0, and the bias.

    prior: the share of label 1 among all labelled rows; the sample's classes are weighted back to it.
    """
    if len(set(labels)) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    features = [doc_features(t) for t in texts]
    y = np.array(labels)
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, times = features[i]
            step = rate * (1 - done / steps) * weight[i]
            done += 1
            if not len(ids):
                continue
            part = (times / times.sum()).astype(np.float32)
            mean = part @ vectors[ids]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            # every distinct bucket occurs once in ids, so this is a plain scatter
            vectors[ids] -= (step * np.sqrt(len(ids))) * part[:, None] * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts; remembers the sum of each word's contributions and their number."""

    def __init__(self, logit: np.ndarray, bias: float):
        self.logit, self.repeat, self.bias = logit, float(logit[REPEAT]), bias
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def _learn(self, words: list[str]) -> None:
        ids, owners = word_features(words)
        at = len(self.place)
        if at + len(words) > len(self.sums):
            more = np.zeros(max(len(words), len(self.sums), 1 << 14))
            self.sums, self.counts = np.concatenate([self.sums, more]), np.concatenate([self.counts, more])
        self.sums[at : at + len(words)] = np.bincount(owners, self.logit[ids], len(words))
        self.counts[at : at + len(words)] = np.bincount(owners, minlength=len(words))
        self.place.update(zip(words, range(at, at + len(words)), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        if len(self.place) > REMEMBERED:
            self._forget()
        split = [split_words(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.place})
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        found = []
        for words in split:
            total, n = 0.0, 0.0
            if words:
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                twice = int((at[1:] == at[:-1]).sum())
                total, n = self.sums[at].sum() + twice * self.repeat, self.counts[at].sum() + twice
            found.append(float(1 / (1 + np.exp(-(total / n if n else 0.0) - self.bias))))
        return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, per_class: int) -> tuple[list[str], list[int], float]:
    """Texts and labels of a bounded sample of the rows that may be learned from, and the share of label 1 among all of them."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).where(crc("doc_id", modulus) != left_out)
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # the ids alone are sampled first: about per_class for each of two labels, so the broadcast side is bounded
    picked = F.broadcast(bounded_sample(known, "doc_id", "y", per_class))
    rows = docs.select("doc_id", "text").where(F.length("text") <= MAX_TRAIN_CHARS).join(picked, "doc_id").select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["y"] for r in rows], shares.get(1, 0) / sum(shares.values()) if shares else 0.5


def score_texts(docs: DataFrame, model: tuple, make: Callable[..., object], name: str, modulus: int, left_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; make(*model) builds a worker's scorer."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make(*shared.value)
        for batch in batches:
            scores: list[float] = []
            for at in range(0, len(batch), 128):
                scores += scorer.scores([x or "" for x in batch.column(1).slice(at, 128).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(crc("doc_id", modulus) == left_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.3, modulus: int = 5, left_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labelled rows whose crc32(doc_id) mod modulus is not left_out."""
    model = train(*labelled_sample(docs, labels, "quality", modulus, left_out, per_class))
    return score_texts(docs, model, Scorer, "quality", modulus, left_out, threshold)
