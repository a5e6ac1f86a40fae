"""Text operators against brute force, exact round trips and planted cases, with edge rows in every table."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lakeglass.llm import byte_bpe, decontaminate, language_model_id, line_dedup, lm_score, quality_model, quality_rules, simhash, substring_dedup, toxicity_model
from lakeglass.llm.registry import queries
from lakeglass.llm.substring_dedup import SPAN

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, component_id bigint"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    rng = random.Random(11)
    base = [prose(rng.randint(20, 120), rng) for _ in range(30)]
    passage = prose(40, rng)
    out = [*base, base[0], base[1] + " tail", base[2].replace(" ", "\n", 3), "", None, "   \n\t", "one two", passage]
    out += [prose(15, rng) + " " + passage + " " + prose(rng.randint(0, 15), rng) for _ in range(12)]
    return out + [base[3][:60] * 8, " ".join(["same words here again and again"] * 30), prose(9000, rng)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, ["en", "de", None][i % 3], None, None, "x", 1) for i, t in enumerate(texts())]
    rows += [(3, texts()[1], "de", "s", 5, None, None)]  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return [w for w in (t or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]


def test_substring_dedup(docs, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    first: dict[bytes, int] = {}
    for i, b in rows:
        for s in range(len(b) - SPAN + 1):
            first[b[s : s + SPAN]] = min(i, first.get(b[s : s + SPAN], i))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - SPAN + 1):
            if first[b[s : s + SPAN]] < i:
                gone[s : s + SPAN] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.substring_dedup(docs)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == sorted(want)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed for r in got.collect())
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_dedup_null_ids(spark):
    t = prose(30)
    d = spark.createDataFrame([(None, t), (1, t), (2, t)], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_removed > 0) for r in substring_dedup.substring_dedup(d).collect()} == {(None, False), (1, False), (2, True)}


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(3, 1, 0), (6, None, 0), (9, 0, 1), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs, labels).collect()}
    for r in docs.collect():
        t, w = r.text or "", split(r.text)
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if split(x):
                dup += x in seen
                seen.add(x)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else set()
        cover = {i + k for i, g in enumerate(grams) if g in twice for k in range(8)}
        x = got[r.doc_id, len(w)]
        assert (x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))
        assert x.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (x.base_failed and x.kept)
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.quality_filter(docs, labels.where("false")).columns == docs.columns


def test_quality_rules_select_cutoffs(spark, tmp_path):
    """Against SQL, where one stratum has labels enough for cutoffs and the other has not; edge rows among them."""
    import duckdb

    from lakeglass.llm import registry

    rng = random.Random(17)
    rows = [(i, prose(40, rng) + (prose(30, rng).replace(" ", "!!! ") if i % 10 == 9 else ""), "en") for i in range(400)]
    rows += [(1000 + i, prose(40, rng) + (prose(30, rng).replace(" ", "!!! ") if i % 10 == 9 else ""), "de") for i in range(60)]
    rows += [(2000, None, "en"), (2001, "", None), (None, prose(40, rng), "en"), (5, rows[5][1], "en"), (2002, "a\nb\n\na\n \n" + prose(30, rng), None), (2003, prose(4000, rng), "en")]
    marks = [(i, 0 if i % 10 == 9 else 1, 0) for i, _, _ in rows[:460]] + [(1, 0, 0), (2, None, None), (None, 1, 0), (9999, 1, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = registry.queries()["op1_quality_rules"](spark, str(tmp_path)).select(columns).collect()
    with duckdb.connect() as con:
        for t in ("documents", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['op1_quality_rules']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in range(9, 400, 10)) and all(kept[i] for i in range(0, 400, 10))  # rejected by certified cutoffs
    assert all(kept[1000 + i] for i in range(60))  # too few labels: nothing is rejected
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "-5 AS n_words")
    left = quality_rules.quality_filter(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert {r.n_words for r in left} == {-5} and any(r.doc_id is None for r in left)


def test_binomial_tail(spark):
    rows = spark.createDataFrame([(100, 0), (100, 1), (5000, 20), (60, 3)], "n bigint, k bigint")
    for r in rows.select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        want = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * 0.01 else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def test_simhash(docs, none):
    def mark(t):
        w = split((t or "").translate({c: c + 32 for c in range(65, 91)}))
        if not w:
            return 0
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, mark(r.text)) for r in docs.collect()]
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, f in rows:
            for j, g in rows:
                if (f ^ g).bit_count() <= 2 and root[j] < root[i]:
                    root[i], changed = root[j], True
    got = {(r.doc_id, r.f & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {(i, f, root[i]) for i, f in rows}
    assert simhash.simhash_components(none).count() == 0
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == set(root.values())


def test_byte_bpe(docs, none):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in byte_bpe.byte_bpe(docs, RANKS, public_tokenizers.PATTERN).collect():
        ids = np.array(enc.encode_ordinary(text[r.doc_id]), "<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4 and r.decoded == text[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert byte_bpe.byte_bpe(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.PerfectHash({b"a": 1, b"bc": 2}).get(b"zz") is None


def test_decontamination(spark, docs, none):
    item = prose(25)
    near = item.split()
    near[3], near[12] = "changed", "words"
    d = spark.createDataFrame([(1, prose(30) + " " + item + " " + prose(9)), (2, " ".join(near)), (3, prose(200)), (4, None), (5, item.split()[0])], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (None, item)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contamination(d, bench).collect()} == {(1, 7, 0), (2, 7, 2)}
    assert {r.doc_id for r in decontaminate.decontaminate(d, bench).collect()} == {3, 4, 5}
    assert decontaminate.contamination(none, bench).count() == 0 and decontaminate.contamination(docs, bench.where("false")).count() == 0


def test_decontamination_recall():
    """Items edited as far as the rule allows, planted in longer texts, by their number of words."""
    rng = random.Random(13)
    words = [f"w{i}" for i in range(3000)]
    found = {}
    for n in (8, 16, 30, 50, 80):
        items = [[rng.choice(words) for _ in range(n)] for _ in range(60)]
        index = decontaminate.Index([(i, " ".join(x)) for i, x in enumerate(items)])
        docs = []
        for item in items:
            near = list(item)
            for _ in range(decontaminate.allowed(n)):
                at, kind = rng.randrange(len(near)), rng.randrange(3)
                near[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice(words)]
            text = [rng.choice(words) for _ in range(40)] + near + [rng.choice(words) for _ in range(40)]
            docs.append(decontaminate.word_hashes(" ".join(text).encode(), decontaminate._Hashes()))
        found[n] = len({(d, i) for d, i, _, _ in index.search(docs) if d == i}) / 60
    assert min(found.values()) >= 0.9 and sum(found.values()) / len(found) >= 0.95, found


def test_line_dedup(spark, none):
    a, b = prose(14), prose(14)
    d = spark.createDataFrame([(1, f"{a}\n{b}\n\n!!!"), (2, f"{a.upper()}.\n{prose(14)}"), (3, b), (4, None), (5, ""), (6, f"{b}x")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(d).collect()}
    assert [got[i].n_removed for i in range(1, 6)] == [0, 1, 1, 0, 0]
    assert got[1].text == f"{a}\n{b}\n\n!!!" and got[4].text is None and got[5].text == "" and got[3].text == ""
    assert line_dedup.line_dedup(none).count() == 0


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, e in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def alike(x, y):
    """The rule of line_dedup, on normal forms: by characters, or by words where the longer line is long."""
    if max(len(x), len(y)) > line_dedup.LONG:
        x, y = x.split(), y.split()
    return edits(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9


def edited_lines():
    rng = random.Random(21)
    rows = []
    for n in (1, 2, 4, 8, 14, 20, 40):
        for _ in range(3):
            line = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 8))) for _ in range(n))
            words = line.split()
            words[rng.randrange(n)] = "changed"
            cut = rng.randrange(len(line))
            rows += [line, " ".join(words), line[:cut] + "q" + line[cut:], line + "x", line[1:]]
    boiler = "all rights reserved by the owner of this page "
    return rows + [boiler + rng.choice(WORDS) for _ in range(30)] + [boiler + prose(12, rng) for _ in range(20)]


@pytest.mark.parametrize("crowd", [1, 3, line_dedup.CROWD])
def test_line_dedup_against_all_pairs(spark, crowd):
    """Every pair that shares blocks enough and is similar is linked, however crowded its blocks are."""
    rows = edited_lines()
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    keys = {r.doc_id: set(r["keys"]) for r in line_dedup.lines(d).collect()}
    group = list(range(len(rows)))
    for i, x in enumerate(rows):
        for j in range(i):
            if x == rows[j] or (len(keys[i] & keys[j]) >= line_dedup.SHARED and alike(x, rows[j])):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert {r.doc_id for r in line_dedup.duplicate_lines(d, crowd).collect()} == {i for i, g in enumerate(group) if g != i}


def test_line_dedup_recall(spark):
    """Share of edited lines of 40 words that share blocks enough with their original."""
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        line = prose(40, rng).split()
        rows.append((len(rows), " ".join(line)))
        for changed in (1, 2, 4):
            new = list(line)
            for at in rng.sample(range(40), changed):
                new[at] = "".join(rng.choice("abcdefgh") for _ in range(6))
            rows.append((len(rows), " ".join(new)))
    keys = {r.doc_id: set(r["keys"]) for r in line_dedup.lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = [sum(len(keys[i] & keys[i + k]) >= line_dedup.SHARED for i in range(0, 600, 4)) / 150 for k in (1, 2, 3)]
    assert found[0] >= 0.98 and found[1] >= 0.95 and found[2] >= 0.7


def test_line_dedup_edge_rows(spark):
    line = prose(150, random.Random(4))
    near = line[:300] + "q" + line[300:]
    rows = [(1, line, 7, "x")] * 9 + [(2, near, 7, None), (None, line, 7, "x"), (3, "same id\n" + line, 7, "x"), (3, "same id too", 7, "x"), (4, "", 7, None), (5, None, 7, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int, gone string")
    got = line_dedup.line_dedup(d, counts=False)
    assert got.columns == d.columns and {r.n_lines for r in got.collect()} == {7}
    assert sorted((repr(r.doc_id), r.text) for r in got.collect()) == sorted((repr(i), t) for i, t in [(1, line)] * 9 + [(2, ""), (None, line), (3, "same id"), (3, "same id too"), (4, ""), (5, None)])
    assert sorted((repr(r.doc_id), r.n_lines, r.n_removed) for r in line_dedup.line_dedup(d).collect()) == sorted([("1", 1, 0)] * 9 + [("2", 1, 1), ("None", 1, 0), ("3", 2, 1), ("3", 1, 0), ("4", 1, 0), ("5", 0, 0)])


def test_similar_lines(spark):
    x, w = "abcdefghi " * 9, " ".join(f"word{i}" for i in range(5000))
    pairs = [(x.strip(), "q" * 10 + x[12:].strip()), (x.strip(), "q" * 25 + x[25:].strip()), (w, w.replace("word", "w", 1000)), (w, w.replace("word", "w", 1001))]
    d = spark.createDataFrame(pairs, "x string, y string").select(line_dedup.forms(F.col("x")).alias("x"), line_dedup.forms(F.col("y")).alias("y"))
    assert [r[0] for r in d.select(line_dedup.similar(F.col("x"), F.col("y"))).collect()] == [True, False, True, False]


def test_lm_scores(docs, none):
    got = lm_score.lm_scores(docs, RANKS).collect()
    tokens = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in split(t)] + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts: dict = {}
    rows = docs.collect()
    for r in rows:
        for w in tokens(r.text) if not held(r.doc_id) else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = {(r.doc_id, len(tokens(r.text))): sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(r.text)) for r in rows}
    for r in got:
        assert r.train_tokens == n and r.held_out == held(r.doc_id) and r.base_score == pytest.approx(want[r.doc_id, r.n_tokens]) and r.score < 0
    assert len(got) == len(rows) and lm_score.lm_scores(none, RANKS).count() == 0


def test_lm_scores_token_by_token(spark, monkeypatch):
    """The network's part against a plain loop over tokens, with fixed weights and classes."""
    ranks, par = byte_bpe.load_ranks(RANKS), lm_score.initial()
    classes = {ranks[bytes([c])]: 2 + i for i, c in enumerate(b"abcdefgh")}
    classes |= {ranks[x]: 10 + i for i, x in enumerate((b"th", b"in", b"re", b"er"))}
    monkeypatch.setattr(lm_score, "_fit", lambda learned, ranks: (classes, par))
    rows = [(i, t) for i, t in enumerate([prose(3), prose(70), "", None, "a" * 400 + " in", "The THE the"])] + [(100 + i, prose(40)) for i in range(30)]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), RANKS).collect()
    low = lambda t: [w.lower().encode() for w in split(t)]
    kind = lambda w: classes.get(lm_score.subwords(w, ranks)[0], lm_score.OTHER) if w is not None else lm_score.END
    counts: dict = {}
    for i, t in rows:
        for w in [*low(t), None] if zlib.crc32(str(i).encode()) % 7 != 2 else ():
            counts[w] = counts.get(w, 0) + 1
    size = {k: sum(c + 1 for w, c in counts.items() if kind(w) == k) + 1 for k in range(lm_score.CLASSES)}
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    scores = {r.doc_id: r.score for r in got}
    for i, t in rows:
        words, total = low(t), 0.0
        inputs = [par["start"].astype(float)]
        for w in words:
            ids = lm_score.subwords(w, ranks)
            inputs.append(sum(par["piece"][j % lm_score.BUCKETS] for j in ids) / math.sqrt(len(ids)) + par["cls"][kind(w)])
        for place, w in enumerate([*words, None]):
            window = max(0, -(-(place + 1 - lm_score.CONTEXT) // (lm_score.CONTEXT - lm_score.OVERLAP))) * (lm_score.CONTEXT - lm_score.OVERLAP)
            x = np.array([inputs[p] + par["pos"][p - window] for p in range(window, place + 1)])
            weights = soft(x @ par["k"] @ (x[-1] @ par["q"]) / math.sqrt(lm_score.DIM))
            z = np.tanh((x[-1] + weights @ (x @ par["v"])) @ par["hid"]) @ par["out"] + par["bias"]
            total += math.log10(soft(z)[kind(w)] * (counts.get(w, 0) + 1) / size[kind(w)])
        assert scores[i] == pytest.approx(total, rel=1e-4)


def test_lm_beats_counts_on_held_out_texts(spark):
    rng = random.Random(2)
    kinds = [[f"{c}{w}" for w in WORDS[:60]] for c in "aeiou"]
    rows = [(i, " ".join(rng.choice(kinds[i % 5]) for _ in range(500))) for i in range(800)]
    held = [r for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), RANKS).collect() if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_causal():
    par, x = lm_score.initial(), np.random.default_rng(1).normal(size=(1, lm_score.CONTEXT, lm_score.DIM)).astype(np.float32)
    y = x.copy()
    y[0, 20:] += 1
    assert np.allclose(lm_score.forward(x, par)[0][0, :20], lm_score.forward(y, par)[0][0, :20])
    for n in (1, 8, 9, 31, 32, 33, 500):
        starts, skip = lm_score.cut(n)
        scored = [p for s, k in zip(starts, skip, strict=True) for p in range(s + k, min(n, s + lm_score.CONTEXT))]
        assert scored == list(range(n))


def labelled(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        bad = i % 2
        group, insult = rng.random() < 0.5, rng.random() < 0.5
        t = prose(30, rng) + (" buy cheap pills now" * 4 if bad else "") + (" grobvolk" if group else "") + (" dumbskull" if insult else "")
        rows.append((i, t))
        marks.append((i, 1 - bad, int(group and insult)))
    return spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string"), spark.createDataFrame([*marks, (902, None, None)], "doc_id bigint, quality int, toxic int")


def test_classifiers(spark):
    docs, labels = labelled(spark)
    marks = {r.doc_id: r for r in labels.collect()}
    for model, name, least in ((quality_model.quality_model, "quality", 0.95), (toxicity_model.toxicity_model, "toxic", 0.8)):
        rows = model(docs, labels).collect()
        held = [r for r in rows if r.held_out and r.doc_id in marks]
        assert len(rows) == 402 and all(0 <= r.score <= 1 for r in rows)
        assert sum(r.predicted == marks[r.doc_id][name] for r in held) / len(held) >= least
        assert model(docs, labels.where("false")).count() == 402 and model(docs.where("false"), labels).count() == 0


def test_toxicity_learns_pairs():
    """An insult together with a group is toxic, either alone is not: the weights alone do worse than weights and pairs."""
    rng = random.Random(6)
    rows = []
    for _ in range(1500):
        group, insult = rng.random() < 0.5, rng.random() < 0.5
        rows.append((prose(30, rng) + (" grobvolk" if group else "") + (" dumbskull" if insult else ""), int(group and insult)))
    learn, held = rows[:1200], rows[1200:]
    w0, w, v = toxicity_model.train([t for t, _ in learn], [y for _, y in learn], 0.25)
    right = lambda v: sum((toxicity_model.machine(toxicity_model.terms(t), w0, w, v) > 0) == bool(y) for t, y in held) / len(held)
    assert right(v) >= 0.9 and right(v) > right(np.zeros_like(v)) + 0.05


def test_language_id(spark, none):
    rng = random.Random(9)
    en, xx = ["the", "and", "with", "house", "green"], ["ża", "ćmił", "śnieg", "łąka", "źdźbło"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else xx) for _ in range(40)), "en" if i % 2 else "pl") for i in range(200)]
    d = spark.createDataFrame([*rows, (500, None, "en"), (501, "123 !", None), (502, "the house and", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_model_id.language_id(d).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out) / sum(got[i].held_out for i, _, _ in rows) > 0.95
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "en"
    assert language_model_id.language_id(none).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts()[5])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in rows]
    assert 15 not in ids and {0, 3, 6} <= set(ids) and len(ids) == len(set(ids)) + 1  # 15 holds the benchmark item; both rows of document 3 are one document
    assert len(queries()) == 13
