"""Secret scans, conversation repair and source divergence against brute force, with edge rows in every table."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from math import inf, log2

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeglass.llm import conversation_repair, secret_scan, source_divergence

DOCS = "doc_id bigint, text string, lang string, source string, spans string, n bigint"
BIG = (1 << 53) + 1


# secrets


def texts():
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["the", "house", "blue", "summer", "winter", "river"]) for _ in range(n))
    out = ['api_key = "abcdef0123456789abcdef0123456789"', "AKIA" + "Z9" * 8 + " and AKIAAKIASHORT", "token: abc", "TOKEN:abcdef.", "secret=token=abcdef", "f" * 24 + "g" + "0" * 23, None, "", "  \n"]
    out += ["password: summer", "password: x7Kq9!mZp2", "my passphrase is Tr0ub4dor&3.", "compass is x7Kq9!mZp2", "bearer é\U0001f600 x", 'pwd -> "zQ8\U0001f6009kLm2vB", ok', "token" + " " * 50_000]
    out += [filler(300) + f" password={v} " + filler(5) for v in ("summerwinter", "aaaaaaaaaaaa", "qwertyuiop", "19991231", "kX2#vN8$qL", "xqzjvkwpyh")]
    return out + ["password: xqzjvkwpyh"] * 30 + [filler(60_000) + " secret: 9fQz!27LmXw"]


def brute_bits(value, words):
    """Shortest path over all segments, each listed with its cost."""
    low, n = value.lower(), len(value)
    edges = defaultdict(list)
    for i, j in itertools.combinations(range(n + 1), 2):
        part = value[i:j]
        edges[j].append((i, sum(map(secret_scan.class_bits, part))))
        for form in (low[i:j], low[i:j].translate(secret_scan.FOR_LETTERS)):
            if form in words and 3 <= j - i <= 24:
                edges[j].append((i, words[form] + secret_scan.case_bits(part) + sum(a != b for a, b in zip(form, low[i:j]))))
        if re.fullmatch(secret_scan.DATE, part):
            edges[j].append((i, log2(150 * 365)))
        if re.fullmatch(secret_scan.YEAR, part):
            edges[j].append((i, log2(150)))
        for u in range(1, 13):
            k = (j - i) // u
            if (j - i) % u == 0 and k >= (3 if u == 1 else 2) and part == part[:u] * k and value[j : j + u] != part[:u]:
                edges[j].append((i, sum(map(secret_scan.class_bits, part[:u])) + log2(k)))
        step = [secret_scan.STEPS.get(p) for p in itertools.pairwise(low[i:j].translate(secret_scan.SHIFTED))]
        if j - i > 2 and None not in step and (j == n or secret_scan.STEPS.get(tuple(low[j - 1 : j + 1].translate(secret_scan.SHIFTED))) is None):
            edges[j].append((i, secret_scan.KEYS + log2(j - i) + secret_scan.TURN * sum(a != b for a, b in itertools.pairwise(step))))
    best = [0.0] + [inf] * n
    for j in range(1, n + 1):
        best[j] = min(best[i] + secret_scan.KIND + b for i, b in edges[j])
    return best[n]


def test_guess_bits():
    rng, words = random.Random(1), {"pass": 4.0, "word": 5.0, "password": 7.0, "dragon": 9.0, "late": 8.0}
    fixed = ["password1", "P4ssw0rd!", "qwertyuiop", "dragon1987", "aaaaaaa", "abcabcabc", "1999-12-31x", "zaq12wsx", "DRAGON", "", "x", "ppasswordd", "é\U0001f600é"]
    for value in fixed + ["".join(rng.choice("aAbq1290-pw4!$") for _ in range(rng.randint(1, 14))) for _ in range(200)]:
        assert secret_scan.guess_bits(value, words) == pytest.approx(brute_bits(value, words)), value
    assert secret_scan.guess_bits("password", words) < 10 < 33 < secret_scan.guess_bits("x7Kq9!mZp2", words)


def test_secrets(spark):
    rows = [(i if i % 5 else None, t, None, None, "x", 1) for i, t in enumerate(texts())] + [(BIG, "token=abcdef", None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_scan.digest(secret_scan.secrets(docs, share=0.001)).collect())
    counts, cut = Counter(), {}
    for _, t, *_ in rows:
        t = t or ""
        held = secret_scan.candidates(t)
        for s, v in held:
            t = t[:s] + " " * len(v) + t[s + len(v) :]
        counts.update(re.findall(r"[^\W\d_]+", t.lower()))
    counts = {w: n for w, n in counts.items() if 3 <= len(w) <= 24}
    total = sum(counts.values())
    cut = {w: log2(total / n) for w, n in counts.items() if n >= 0.001 * total}
    assert "summer" in cut and "xqzjvkwpyh" not in cut
    want: Counter = Counter()
    for i, t, *_ in rows:
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        for k, (p, least) in enumerate([("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)], 1):
            base += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[0]) >= least]
        more = [(s, 3, s + len(v)) for s, v in secret_scan.candidates(t) if brute_bits(v, cut) >= secret_scan.BITS]
        say = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        n = Counter(k for _, k, _ in base)
        want[(i, n[0], n[1], n[2], hashlib.sha256(say(base).encode()).hexdigest(), say(base + more))] += 1
    assert got == want
    value = "my passphrase is Tr0ub4dor&3."
    assert any(r[5] == f"guess:17:{len(value) - 1}" for r in got)
    assert secret_scan.secrets(docs.limit(0)).count() == 0


# conversations

NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def cheapest(rows):
    """rows: (initial, fault, role, text). The least (cost, audit, repaired) by a forward table of states."""
    lines = {"u": "user:", "a": "assistant:"}

    def grown(best):
        todo = list(best)
        while todo:
            q = todo.pop()
            c, a, r = best[q]
            for x in "ua":
                if (x, q) in NEXT:
                    new = (c + 2, a + "I", (*r, lines[x]))
                    if NEXT[x, q] not in best or new[:2] < best[NEXT[x, q]][:2]:
                        best[NEXT[x, q]] = new
                        todo.append(NEXT[x, q])
        return best

    best = grown({0: (0, "", ())})
    for x, fault, role, text in rows:
        new: dict = {}
        for q, (c, a, r) in best.items():
            ways = [(q, c + 3, a + "D", r)]
            if fault not in ("blank", "duplicate"):
                t = fault == "truncated"
                ways += [(NEXT[x, q], c + t, a + "K", (*r, f"{role}:{text}"))] if (x, q) in NEXT else []
                ways += [(NEXT[y, q], c + 2 + t, a + "R", (*r, lines[y] + text)) for y in "ua" if (y, q) in NEXT]
            for to, *way in ways:
                if to not in new or way[:2] < list(new[to][:2]):
                    new[to] = tuple(way)
        best = grown(new)
    return min(best[q] for q in (0, 3) if q in best)


def expected(table):
    ids, kept = {r[0] for r in table}, defaultdict(list)
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = Counter()
    for conv in ids:
        rows, seen, told, n = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])), set(), [], Counter()
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            told.append((role[:1], fault, role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, repaired = cheapest(told)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        out[(conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())] += 1
    return out


def conversations():
    rng, rows = random.Random(8), []
    say = lambda: rng.choice(["Yes.", "No!", "cut off", "", "  \n", "Why? ", "naïve \U0001f600.", None, "long " * 50 + "."])
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv * 7, turn * rng.choice([1, 1, 1, 3]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), say()))
    rows += [(1000, None, "user", "Hi."), (1000, None, "user", "Hi."), (1000, 5, "assistant", "Ho."), (1000, 5, "assistant", "Ho."), (1000, 5, "assistant", "Ha."), (None, 3, "user", "Hi."), (None, None, None, None)]
    rows += [(BIG, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(12)]
    rows += [(2000, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"Say {t}.", "Again.", f"cut {t}", ""])) for t in range(700)]
    return rows


def test_segments_against_brute_force():
    rng = random.Random(2)
    names = {".": "", "t": "truncated", "b": "blank", "d": "duplicate"}
    for _ in range(1500):
        rows = [(rng.choice("suax"), rng.choice("...tbd")) for _ in range(rng.randint(0, 8))]
        t = conversation_repair.Segment("".join(a + b for a, b in rows), None).trace(conversation_repair.START)
        assert (t.cost, t.audit) == cheapest([(a, names[b], a, "") for a, b in rows])[:2]


@pytest.mark.parametrize("segment", [3, 256])
def test_conversation_repair(spark, segment):
    table = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id bigint, turn bigint, role string, text string, key string, n int").repartition(5)
    got = Counter(map(tuple, conversation_repair.damaged_and_repaired(df, segment).collect()))
    assert got == expected(table)


def test_conversation_repair_of_nothing_and_everything(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_repair.damaged_and_repaired(none).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Who?"), (2, 0, "user", " ")], none.schema)
    found = conversation_repair.repair(rows)
    assert {r.conv_id: (r.cost, r.audit) for r in found.report.collect()} == {1: (2, "KR"), 2: (3, "D")}
    assert [(r.role, r.text) for r in found.turns.orderBy("seq", "part").collect()] == [("user", "Hi."), ("assistant", "Who?")]
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in conversation_repair.damaged_and_repaired(spark.createDataFrame([(gone, 0, "user", "Hi.")], none.schema)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_conversation_sql(spark):
    c, table = duckdb.connect(), conversations()[:300]
    c.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", table)
    assert Counter(map(tuple, c.sql(conversation_repair.oracle_sql()).fetchall())) == expected(table)


# divergence


def divergent():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "ünder", "日本", "x", "Zeta", "rare"]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None, "ä"])
        weights = [1 + (source == "a") * 5, 3, 1, 2, 1 + (source == "b") * 4, 6, 1, 0.02]
        rows.append((i if i % 9 else None, " ".join(rng.choices(words, weights, k=rng.randint(0, 30))) + "'s 12\x00q", lang, source, "x", 1))
    rows += [(BIG, None, "en", "empty", None, None), (5, "", "fr", "only", None, None), (5, "", "fr", "other", None, None), (6, "alpha alpha", "it", "one", None, None)]
    return rows + [rows[0]] * 2


def test_divergence(spark):
    docs = spark.createDataFrame(divergent(), DOCS)
    groups, seen, counts = set(), defaultdict(set), Counter()
    for i, (_, text, lang, source, *_) in enumerate(divergent()):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            seen[lang, t].add(i)
            counts[lang, source, t] += 1
    kept = {k for k, who in seen.items() if len(who) >= 3}
    assert ("en", "rare") in seen
    p = {}
    for lang in {g[0] for g in groups}:
        terms = [t for a, t in kept if a == lang]
        for source in [s for a, s in groups if a == lang]:
            n = {t: counts[lang, source, t] for t in terms}
            p[lang, source] = {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(terms)) for t in terms}
        n = {t: sum(counts[lang, s, t] for a, s in groups if a == lang) for t in terms}
        p[lang, None] = {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(terms)) for t in terms}
    f = lambda a, b: (a - b) ** 2 // b
    want = set()
    for lang, source in groups:
        own, q = p[lang, source], p[lang, None]
        pairs = [(-sum(f(own[t], p[lang, s][t]) for t in own), s.encode()) for a, s in groups if a == lang and s != source]
        terms = [(-f(own[t], q[t]), t.encode()) for t in own if counts[lang, source, t] and own[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            want |= {(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found), 1)}
    got = [tuple(r) for r in source_divergence.divergence(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = {r for r in want if r[2] == "pair" or r[5] <= 2}
    assert {tuple(r) for r in source_divergence.divergence(docs.repartition(7), top=2).collect()} == few
    assert source_divergence.divergence(docs.limit(0)).count() == 0
    c = duckdb.connect()
    c.register("documents", docs.drop("spans", "n").toArrow())
    assert set(map(tuple, c.sql(source_divergence.oracle_sql()).fetchall())) == want


# ids


def test_large_ids_beside_null(spark):
    """Ids beyond 2^53 come back as they are where a null id is in the same batch."""
    import public_tokenizers

    from lakeglass.llm import byte_bpe, language_model_id, lm_score, simhash

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(None, "something else", "en", None, None, None), (BIG, text, "en", None, None, None), (BIG + 2, text, "en", None, None, None), (3, "other words again", "de", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    ids = {r[0] for r in rows}
    assert {r.doc_id for r in lm_score.lm_scores(docs, ranks).collect()} == ids
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert found == {None: None, BIG: BIG, BIG + 2: BIG, 3: 3}
    assert {r.doc_id for r in byte_bpe.byte_bpe(docs, ranks, public_tokenizers.PATTERN).collect()} == ids
    assert {r.doc_id for r in language_model_id.language_id(docs).collect()} == ids


def test_copies_certify_nothing(spark):
    """A good document of 200 rows is one document of evidence; it counts as rejected if any of its rows is."""
    from lakeglass.llm import quality_rules

    good = " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    loud = good.replace(" ", " ! ! ")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(1, good, "en")] * 200 + [(1, loud, "en"), (2, good, "en")], "doc_id bigint, text string, lang string")
    measured = quality_rules.signals(docs.withColumn("stratum", F.col("lang"))).withColumn("base_failed", quality_rules.base_failed()).withColumns(quality_rules.features())
    assert [(r.stratum, r.n, r.step) for r in quality_rules.steps(measured, labels).collect()] == [("en", 2, None)]
