"""What a review found on odd inputs and larger tables."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lakeglass.llm import line_dedup, lm_score, substring_dedup


def test_repeated_corpus_is_answered_in_a_byte_a_phrase():
    """Where everything is repeated, what goes back to the slices stays small beside the texts."""
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 200_000).astype(np.uint8).tobytes()
    slices = [pa.table({"slice": pa.array([i], pa.int64()), "doc_id": pa.array([10 - i], pa.int64()), "data": pa.array([text], pa.binary())}) for i in range(4)]
    sent = pa.concat_tables([substring_dedup._sender(1)(x) for x in slices])
    answers = substring_dedup._answer(sent)
    size = sum(len(x) for c in ("key", "value", "flag") for x in answers.column(c).to_pylist())
    assert 0 < size < 0.1 * 4 * len(text)
    last = substring_dedup._Slice(slices[3], answers.filter(pa.array(answers.column("slice").to_numpy() == 3)), 1)
    assert len(last.told.key) and (last.told.values[0] == 7).all() and (last.told.values[1] == 0).mean() > 0.99  # a phrase at the edge of a block comes in two
    first = substring_dedup._Slice(slices[0], answers.filter(pa.array(answers.column("slice").to_numpy() == 0)), 1)
    assert (first.told.values[0] < 7).all()


def test_batch_rows_are_few_in_a_file(spark, monkeypatch):
    """Rows of several MB: a writer of many, and a reader of a file of many, would hold them all at once."""
    import public_tokenizers

    kept = []
    plain = lm_score.durable
    monkeypatch.setattr(lm_score, "durable", lambda *a: kept.append(plain(*a)) or kept[-1])
    monkeypatch.setattr(lm_score, "BATCH_BYTES", 1000)
    rows = [(i, f"word{i} " * 200) for i in range(12)]
    lm_score.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    packed = next(d for d in kept if "places" in d.columns)
    sizes = [r["count"] for r in packed.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 12 and max(sizes) <= lm_score.FILE_BATCHES


def test_model_learns_from_every_token(spark):
    """A share of the windows would leave most short documents out: classes and weights come from each of them."""
    import public_tokenizers

    ranks = lm_score.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    words = [bytes([c]) * 3 + b"q" for c in b"bcdfghjkmnpqrstvwxyz"]
    rows = [(i, f"{w.decode()} {words[i - 1].decode()}") for i, w in enumerate(words)]
    classes, par = lm_score._fit(spark.createDataFrame(rows, "doc_id bigint, text string"), ranks)
    assert set(classes) == {lm_score.subwords(w, ranks, 1)[0] for w in words}
    read = sorted({p % lm_score.BUCKETS for w in words for p in lm_score.subwords(w, ranks)})
    moved = np.abs(par["piece"] - lm_score.initial()["piece"]).max(1)
    assert (moved[read] > 0).all() and np.count_nonzero(moved) == len(read)
    assert lm_score.train_shard([b"a b " * 100, b"", b"c"], ranks, classes, par, 0.01)[1] == 204


def test_unlike_lines_of_a_crowd_are_not_all_compared(spark, monkeypatch):
    """Lines of 15 common and 4 own words are not similar: pairs that are verified grow with the lines, not with their square."""
    rng = random.Random(31)
    own = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    common = [own() for _ in range(15)]
    rows = [(i, " ".join([*common, *(own() for _ in range(4))])) for i in range(200)]
    made, verify = [], line_dedup._links
    monkeypatch.setattr(line_dedup, "_links", lambda pairs, *a: made.append(pairs.count()) or verify(pairs, *a))
    near = (200, rows[7][1].replace(common[3], "changed"))
    gone = {r.doc_id for r in line_dedup.duplicate_lines(spark.createDataFrame([*rows, near], "doc_id bigint, text string")).collect()}
    assert gone == {200} and sum(made) < 40 * len(rows), made
