"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct lower-case words without the punctuation around them and the first five letters of the longer
ones (an inflected or compounded insult is still one), hashed. The score is
sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>): besides each term's weight, the machine learns which terms are toxic
together (an insult and the group it is aimed at), which a linear model cannot. The sum over pairs takes time linear in the
terms: half of |sum v_i|^2 - sum |v_i|^2. A long text has many pairs of no meaning; the pair term is therefore divided by the
square root of the number of terms.

Fitted by AdaGrad in numpy on a bounded sample of labelled rows, broadcast (buckets x (factors + 1) numbers) and applied to
whole texts where they are read.

Defined results: null, empty and blank texts have no terms and get sigmoid(w0). Null labels are not learned from; a document
labelled more than once is toxic if any label says so. With no labels or one class, every score is that class's share. Rows are scored one by
one: repeated rows give repeated scores, a null doc_id is not held out and has no label. No documents: no rows.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .quality_model import REMEMBERED, labelled_sample, score_texts, split_words

BUCKETS, FACTORS, STEM, PER_CLASS = 1 << 18, 4, 5, 5000
AROUND = ".,;:!?\"'()[]{}<>*#|-_`~¡¿«»“”‘’…"


def word_terms(word: str) -> tuple[int, ...]:
    """The buckets of a word: none if nothing but punctuation is left, two if it is longer than its stem."""
    bare = word.lower().strip(AROUND)
    whole = (zlib.crc32(bare.encode("utf-8", "surrogatepass")) % BUCKETS,) if bare else ()
    return whole + (zlib.crc32(b"\x01" + bare[:STEM].encode("utf-8", "surrogatepass")) % BUCKETS,) if len(bare) > STEM else whole


def terms(text: str) -> np.ndarray:
    """A text's distinct terms."""
    return np.array(sorted({t for w in set(split_words(text)) for t in word_terms(w)}), np.int64)


def machine(ids: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> float:
    if not len(ids):
        return w0
    chosen = v[ids]
    total = chosen.sum(0)
    return w0 + float(w[ids].sum()) + 0.5 * float(total @ total - (chosen * chosen).sum()) / float(np.sqrt(len(ids)))


def train(texts: list[str], labels: list[int], prior: float, epochs: int = 12, rate: float = 0.5, pair_rate: float = 0.1, shrink: float = 5e-4, start: float = 10.0, pair_start: float = 1.0, spread: float = 0.1, settled: float = 0.003, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """w0, w and v by AdaGrad, one document at a time, until an epoch lowers the loss by a share of `settled` or less."""
    w, v, rng = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32), np.random.default_rng(seed)
    if len(set(labels)) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return float(np.log(p / (1 - p))), w, v
    docs = [terms(t) for t in texts]
    y = np.array(labels)
    # terms of one or two documents cannot be told from these documents' labels; they are not learned, and stay out of the pairs
    seen = np.zeros(BUCKETS, np.int32)
    for ids in docs:
        seen[ids] += 1
    docs = [ids[seen[ids] > 2] for ids in docs]
    # factors of some size from the start: at nought, a pair's pull on either side is nought too
    # (accumulators start high, so that a term moves far only if many documents push it the same way)
    v[seen > 2] = rng.normal(0, spread, (int((seen > 2).sum()), FACTORS))
    gw, gv, w0, g0 = np.full(BUCKETS, start, np.float32), np.full((BUCKETS, FACTORS), pair_start, np.float32), 0.0, start
    share = y.mean()
    # half of the way (by logarithm) back from the sample's shares to those of all labelled rows: rare insults count more
    weight = np.sqrt(np.where(y == 1, prior / share, (1 - prior) / (1 - share)))
    before = np.inf
    for _ in range(epochs):
        loss = 0.0
        for i in rng.permutation(len(y)):
            ids = docs[i]
            z = np.clip(machine(ids, w0, w, v), -30, 30)
            loss += float(np.logaddexp(0, -z if y[i] else z) * weight[i])
            error = float((1 / (1 + np.exp(-z)) - y[i]) * weight[i])
            g0 += error * error
            w0 -= rate * error / np.sqrt(g0)
            if not len(ids):
                continue
            grad = error + shrink * w[ids]
            gw[ids] += grad * grad
            w[ids] -= rate * grad / np.sqrt(gw[ids])
            chosen = v[ids]
            pull = error * (chosen.sum(0) - chosen) / np.sqrt(len(ids)) + shrink * chosen
            gv[ids] += pull * pull
            v[ids] -= pair_rate * pull / np.sqrt(gv[ids])
        if loss > before * (1 - settled):
            break
        before = loss
    return float(w0), w, v


class _Terms(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = buckets = word_terms(word)
        return buckets


class Scorer:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v, self.known = w0, w, v, _Terms()

    def scores(self, texts: list[str]) -> list[float]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = []
        for text in texts:
            ids = np.array(list(set(chain.from_iterable(map(self.known.__getitem__, set(split_words(text)))))), np.int64)
            ids.sort()
            found.append(float(1 / (1 + np.exp(-np.clip(machine(ids, self.w0, self.w, self.v), -500, 500)))))
        return found


def toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5, modulus: int = 5, left_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labelled rows whose crc32(doc_id) mod modulus is not left_out."""
    model = train(*labelled_sample(docs, labels, "toxic", modulus, left_out, per_class))
    return score_texts(docs, model, Scorer, "toxic", modulus, left_out, threshold)
