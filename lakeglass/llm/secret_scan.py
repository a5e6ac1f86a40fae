"""Secret scans: fixed patterns, and the guess cost of what stands in the context of a credential.

Patterns (kinds assign, access and hex) give the base. The method adds spans of kind guess: a value that follows a word such as password, token or
bearer is a secret if an attacker who knows the language of the corpus needs at least 2^BITS guesses for it. The cost of a value in bits is that of its
cheapest segmentation, found by dynamic programming over its characters:

    word      log2(words of the corpus / occurrences of this word), and bits for capitals and for digits or signs put for letters
    date      the days of SPAN_YEARS years, or a year of them
    repeat    the unit by brute force and log2(times), units of up to UNIT characters, as often as they follow
    walk      neighbours on the keyboard, or the next letter or digit; log2 of first key and length, and bits for each turn
    brute     the size of each character's class

and each segment adds KIND bits for what it is. So `password: thirteenth1987` is cheap, and a value of random letters is not.

One pass over the texts: a task gives each document's base spans and candidate values, and counts of the words of 3 to 24 letters outside of the candidates (a secret must not
make itself a word, however often its document was copied). Counts of all documents are added up by a shuffle. A word is in the dictionary if it is at least SHARE of all
words: so at most 1 / SHARE words, whatever the corpus, and these are broadcast. The second step reads candidates, no texts.

Defined results: a null or empty text has no spans. A row is a document: rows without doc_id and repeated rows have results of their own. Spans of different kinds may
overlap, equal starts go by the order of the kinds. Positions are code points of the whole text, ends exclusive. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb, inf, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
#: `AKIA[A-Z0-9]+` of 20 and `[0-9a-f]+` of 24 characters: a shorter run holds no longer one, so the bounds can stand in the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: What a credential's value follows: a name, then a sign that assigns, a verb or a space.
CONTEXT = re.compile(
    r"""(?-i:(?<![a-z]))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private)[ _-]?key|auth|bearer)["']?"""
    r"""(?:\x20*+(?P<sign>:=|=>|->|[:=])\x20*+|\x20++(?:is|was)\x20++|\x20++)["'`]?(?P<value>[^\x00-\x20"'`<>(){}\[\],;]+)""",
    re.IGNORECASE | re.ASCII,
)
BITS = 33.2
KIND = log2(5)
SHARE = 2.0**-18
SHORTEST, LONGEST = 3, 24
UNIT = 12
FIRST_YEAR, LAST_YEAR = 1900, 2049
SPAN_YEARS = LAST_YEAR - FIRST_YEAR + 1
LETTERS = re.compile(r"[^\W\d_]+")
#: Signs and digits that stand for letters.
FOR_LETTERS = str.maketrans("014357@$!", "olaestasi")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}:"<>?', "`1234567890-=[];',./")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:0[1-9]|1[0-2])([-/.]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d)")
YEAR = re.compile(r"(?:19\d\d|20[0-4]\d)")
#: Counts of words that a task holds before it hands them on.
HELD = 400_000


def _keyboard() -> dict[tuple[str, str], int]:
    """Direction of the step from one key to a neighbour: along a row, or to the rows above and below, which stand half a key further."""
    place = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row, start=0 if y == 0 else 1)}
    steps = {}
    for a, (y, x) in place.items():
        for b, (v, u) in place.items():
            if v == y and abs(u - x) == 1 or v == y + 1 and u in (x - 1, x) or v == y - 1 and u in (x, x + 1):
                steps[a, b] = 3 * (v - y) + (u - x)
    for run in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        for a, b in zip(run, run[1:]):
            steps.setdefault((a, b), 8)
            steps.setdefault((b, a), 9)
    return steps


STEPS = _keyboard()
KEYS = log2(sum(map(len, ROWS)))
TURN = log2(6)


def class_bits(c: str) -> float:
    if "0" <= c <= "9":
        return log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log2(26)
    return log2(33) if c < "\x80" else 10.0


def case_bits(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or upper == 1 and word[0].isupper():
        return 1.0
    return log2(sum(comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)) + 1)


def guess_bits(value: str, words: dict[str, float]) -> float:
    """The cost of the cheapest segmentation. words: bits of each word of the dictionary."""
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, keys = low.translate(FOR_LETTERS), low.translate(SHIFTED)
    each = [class_bits(c) for c in value]
    total = [0.0]
    for b in each:
        total.append(total[-1] + b)
    # how far the text repeats itself at a distance, and how far a walk goes from each place
    same = [[0] * (n + 1) for _ in range(min(UNIT, n // 2) + 1)]
    for u in range(1, len(same)):
        row = same[u]
        for i in range(n - u - 1, -1, -1):
            row[i] = row[i + 1] + 1 if value[i] == value[i + u] else 0
    step = [STEPS.get((keys[i], keys[i + 1])) for i in range(n - 1)]
    walk, turns = [1] * n, [0] * n
    for i in range(n - 2, -1, -1):
        if step[i] is not None:
            walk[i] = walk[i + 1] + 1
            turns[i] = turns[i + 1] + (walk[i + 1] > 1 and step[i] != step[i + 1])
    best, brute = [0.0] + [inf] * n, [inf] * (n + 1)
    for i in range(n):
        here = best[i] + KIND
        brute[i + 1] = min(here, brute[i]) + each[i]
        best[i + 1] = min(best[i + 1], brute[i + 1])
        for size in range(SHORTEST, min(LONGEST, n - i) + 1):
            for form in {low[i : i + size], plain[i : i + size]}:
                if (bits := words.get(form)) is not None:
                    changed = sum(a != b for a, b in zip(form, low[i : i + size], strict=True))
                    best[i + size] = min(best[i + size], here + bits + case_bits(value[i : i + size]) + changed)
        for pattern, bits in ((DATE, log2(SPAN_YEARS * 365)), (YEAR, log2(SPAN_YEARS))):
            if m := pattern.match(value, i):
                best[m.end()] = min(best[m.end()], here + bits)
        for u in range(1, len(same)):
            times = same[u][i] // u + 1
            if times > 2 or times == 2 and u > 1:
                end = i + u * times
                best[end] = min(best[end], here + total[i + u] - total[i] + log2(times))
        if walk[i] > 2:
            end = i + walk[i]
            best[end] = min(best[end], here + KEYS + log2(walk[i]) + TURN * turns[i])
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, str]]:
    """(start, value) of what follows a credential's name. Where nothing assigns it, the value must have letters and digits."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m["value"].rstrip(".:!?")
        if value and (m["sign"] or re.search(r"\d", value) and re.search(r"[A-Za-z]", value)):
            out.append((m.start("value"), value))
    return out


SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
VALUES = pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string())]))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of word counts with no document."""
    seen: Counter[str] = Counter()
    id_type: pa.DataType = pa.int64()

    def counts() -> pa.RecordBatch:
        held = [w for w in seen if SHORTEST <= len(w) <= LONGEST]
        n, none = [seen[w] for w in held], [None] * len(held)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(none, id_type), pa.array(none, SPAN), pa.array(none, VALUES), pa.array(held, pa.string()), pa.array(n, pa.int64())], names=names)

    names = ["doc_id", "base", "found", "word", "n"]
    for batch in batches:
        id_type = batch.column(0).type
        base, found = [], []
        for scalar in batch.column(1):
            text = scalar.as_py() or ""
            base.append([{"kind": k, "start": s, "end": e} for s, k, e in base_spans(text)])
            values = candidates(text)
            found.append([{"start": s, "value": v} for s, v in values])
            at = 0
            for s, v in [*values, (len(text), "")]:
                seen.update(LETTERS.findall(text[at:s].lower()))
                at = s + len(v)
            if len(seen) > HELD:
                yield counts()
        none = pa.nulls(len(base))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, SPAN), pa.array(found, VALUES), none.cast(pa.string()), none.cast(pa.int64())], names=names)
    if seen:
        yield counts()


def dictionary(counts: DataFrame, share: float = SHARE) -> dict[str, float]:
    """Bits of each word that is at least `share` of all words; at most 1 / share of them. counts: word, n, a word as often as tasks met it."""
    summed = durable(counts.groupBy("word").agg(F.sum("n").alias("n")))
    total = summed.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: log2(total / r["n"]) for r in summed.where(F.col("n") >= F.lit(share * total)).collect()}


def secrets(docs: DataFrame, bits: float = BITS, share: float = SHARE) -> DataFrame:
    """doc_id, spans (kind, start, end, bits; bits for guesses only), by start and kind."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span, value = "array<struct<kind:int,start:bigint,end:bigint>>", "array<struct<start:bigint,value:string>>"
    scanned = durable(docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {id_type}, base {span}, found {value}, word string, n bigint"))
    words = scanned.sparkSession.sparkContext.broadcast(dictionary(scanned.where("word IS NOT NULL").select("word", "n"), share))  # at most 1 / share words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = lru_cache(50_000)(lambda v: guess_bits(v, words.value))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
        for batch in batches:
            out = []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(x["start"], x["kind"], x["end"], None) for x in base]
                spans += [(x["start"], 3, x["start"] + len(x["value"]), b) for x in found if (b := cost(x["value"])) >= bits]
                out.append([{"kind": KINDS[k], "start": s, "end": e, "bits": b} for s, k, e, b in sorted(spans, key=lambda x: x[:3])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return scanned.where("word IS NULL").select("doc_id", "base", "found").mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,bits:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from secrets()."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), number("guess"))
