"""Conversation structure repair: the cheapest edits that give each conversation the form system? (user assistant)+, or nothing.

Edits of a row: Keep 0, Rerole (to user or assistant) 2, Delete 3; Insert of an empty user or assistant turn, anywhere, 2. A truncated row that is not
deleted adds 1. Blank and duplicate rows must be deleted. Of all cheapest edits the ASCII-least string of initials (D, I, K, R) is taken.

A prefix of edits leaves the grammar in one of four states: START, after a system turn, after a user turn, after an assistant turn. A layer of cost c has for each
place between rows a bitset of the states from which what follows can be repaired at a cost of exactly c. Layers are made for c = 0, 1, 2, ... from those
1, 2 and 3 below, from the last row to the first; the first layer with the entry state in its first bitset gives the cost. A trace forward through the bitsets takes, of the edits
that stay on a cheapest path, the least initial. As the next state follows from the initial, the trace is the least audit.

At scale a conversation is a group that may hold a third of all rows:

1. Equal rows of one conversation and turn become one with a count; all but the first are duplicates. Whether a row repeats an earlier turn's is known from the least turn
   of its role and text, by an aggregate and a join that Spark can split.
2. Rows are range-partitioned by conversation, turn, role and text, which splits long conversations, and numbered. SEGMENT numbers in a row make a segment: a short string of symbols.
3. A segment's layers run from any costs of its last states, so segments are solved in parallel: (a) a segment of a longer conversation gives the costs from each state to each other; (b) a scan
   over these 16 numbers, from a conversation's last segment to its first, gives each segment what follows it costs from each state; (c) each segment is traced from each entry state; (d) a scan over the states
   at its ends tells which of the traces holds. Rows and texts are in no scan.

The query's digest needs a conversation's texts in order, as SHA-256 has no parallel form: rows are sorted by conversation and pass a hash object one by one,
in constant memory. A conversation of a third of all rows is hashed by one task; nothing else of it is.

Defined results: null role and text count as one space. Rows are ordered by turn (null first), role, text; for a given turn they are a set with counts. A null conv_id is a
conversation of its own. A role other than system, user and assistant has the initial of its first character; an empty role has none and fits nowhere. A conversation without
rows has zeros and an empty audit. Empty tables give empty results. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, durable

START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = 1 << START | 1 << ASSISTANT
#: The state after a turn whose role has the initial, by the state before it.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
#: The initial of the one role that may follow in a state, other than system.
DUE = {q: x for x in "ua" for q in NEXT[x]}
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
SEGMENT = 256
NEVER = 1 << 60
FULL = {"u": "user", "a": "assistant"}

#: For each initial and each bitset of states, the states from which a turn of that role leads into the bitset.
BEFORE = {x: [sum(1 << q for q, r in to.items() if held >> r & 1) for held in range(16)] for x, to in NEXT.items()}
#: The same for a turn that may be user or assistant: an inserted one, or one given another role.
BEFORE_DUE = [u | a for u, a in zip(BEFORE["u"], BEFORE["a"], strict=True)]


class Traced(NamedTuple):
    cost: int
    audit: str
    end: int
    #: For each row: initials inserted before it, its edit (K, R with the new initial, D), initials inserted after it.
    plan: tuple[str, ...]


class Segment:
    """A run of rows, each a symbol: the role's initial (x for others) and . or t (truncated), or b or d (to be deleted).

    after: what follows costs from each state; None at a conversation's end, where turns may still be inserted.
    """

    def __init__(self, symbols: str, after: tuple[int, ...] | None):
        self.rows = [(symbols[i], symbols[i + 1]) for i in range(0, len(symbols), 2)]
        self.after = after
        self.forced = DELETE * sum(f in "bd" for _, f in self.rows)
        self.least = 0 if after is None else min(after)
        #: layers[c][i]: the states before row i from which all that follows costs exactly c, forced deletions and the least of `after` aside.
        self.layers: list[list[int]] = []

    def _end(self, c: int) -> int:
        if self.after is None:
            return ACCEPTING if c == 0 else BEFORE_DUE[self.layers[c - INSERT][-1]] if c >= INSERT else 0
        return sum(1 << q for q, x in enumerate(self.after) if x - self.least == c)

    def _layer(self) -> None:
        c, none = len(self.layers), [0] * (len(self.rows) + 1)
        one, two, three = (self.layers[c - k] if c >= k else none for k in (1, 2, 3))
        own = none.copy()
        own[-1] = self._end(c)
        for i in range(len(self.rows) - 1, -1, -1):
            initial, fault = self.rows[i]
            if fault in "bd":
                own[i] = own[i + 1] | BEFORE_DUE[two[i]]
            elif fault == "t":
                own[i] = BEFORE[initial][one[i + 1]] | BEFORE_DUE[three[i + 1]] | three[i + 1] | BEFORE_DUE[two[i]]
            else:
                own[i] = BEFORE[initial][own[i + 1]] | BEFORE_DUE[two[i + 1]] | three[i + 1] | BEFORE_DUE[two[i]]
        self.layers.append(own)

    def _possible(self) -> int:
        """States from which the end can be reached at any cost."""
        held = 15 if self.after is None else sum(1 << q for q, x in enumerate(self.after) if x < NEVER)
        for initial, fault in reversed(self.rows):
            held |= 0 if fault in "bd" else BEFORE[initial][held] | BEFORE_DUE[held]
            held |= BEFORE_DUE[held]
            held |= BEFORE_DUE[held]
        return held

    def costs(self) -> tuple[int, ...]:
        """The least cost from each state before the first row, that of what follows included; NEVER if there is no way."""
        left, found = self._possible(), [NEVER] * 4
        while left:
            self._layer()
            new = self.layers[-1][0] & left
            for q in range(4):
                if new >> q & 1:
                    found[q] = len(self.layers) - 1 + self.forced + self.least
            left &= ~new
        return tuple(found)

    def trace(self, state: int) -> Traced:
        """The least audit among the cheapest from a state."""
        while len(self.layers) < 1 or not any(layer[0] >> state & 1 for layer in self.layers):
            self._layer()
        c = next(k for k, layer in enumerate(self.layers) if layer[0] >> state & 1)
        audit: list[str] = []
        plan: list[str] = []
        inserted, spent = "", 0

        def insert() -> bool:
            nonlocal c, state, inserted, spent
            due = DUE[state]
            if c < INSERT or not self.layers[c - INSERT][i] >> NEXT[due][state] & 1:
                return False
            c, state, inserted, spent = c - INSERT, NEXT[due][state], inserted + due, spent + INSERT
            audit.append("I")
            return True

        for i, (initial, fault) in enumerate(self.rows):
            more = TRUNCATED if fault == "t" else 0
            while True:
                if fault in "bd" and self.layers[c][i + 1] >> state & 1:
                    edit, spent = "D", spent + DELETE
                elif fault not in "bd" and c >= DELETE and self.layers[c - DELETE][i + 1] >> state & 1:
                    edit, c, spent = "D", c - DELETE, spent + DELETE
                elif insert():
                    continue
                elif c >= more and (to := NEXT[initial].get(state)) is not None and self.layers[c - more][i + 1] >> to & 1:
                    edit, c, state, spent = "K", c - more, to, spent + more
                else:
                    edit = f"R{DUE[state]}"
                    c, state, spent = c - RENAME - more, NEXT[DUE[state]][state], spent + RENAME + more
                break
            audit.append(edit[0])
            plan.append(f"{inserted}{edit}")
            inserted = ""
        i = len(self.rows)
        while self.after is None and (c or not ACCEPTING >> state & 1):
            insert()
        if plan:
            plan[-1] += f"|{inserted}"
        return Traced(spent, "".join(audit), state, tuple(plan))


@lru_cache(20_000)
def solved(symbols: str, after: tuple[int, ...] | None, first: bool) -> tuple[Traced | None, ...]:
    """The trace from START, or from each state if the segment is not a conversation's first; None where there is no way."""
    s = Segment(symbols, after)
    possible = s._possible()
    return tuple(s.trace(q) if possible >> q & 1 else None for q in ([START] if first else range(4)))


@lru_cache(20_000)
def transfers(symbols: str) -> tuple[int, ...]:
    """The least cost from each state before a segment to each after it, 16 numbers."""
    to = [Segment(symbols, tuple(0 if r == q else NEVER for r in range(4))).costs() for q in range(4)]
    return tuple(to[r][q] for q in range(4) for r in range(4))


def illegal_pairs(symbols: str) -> int:
    initials = symbols[::2]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows left after the contract's damage by crc32 of `conv_id:turn`."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _key() -> Column:
    """A conversation's key: its id as text, '' for null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def numbered(rows: DataFrame) -> DataFrame:
    """key, seq (ascending in a conversation, without gaps within a segment), turn, role, text, n (copies) and symbol of each different row."""
    each = rows.select(_key().alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies").groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    each = durable(each)
    seen = each.groupBy("key", "role", "text").agg(F.min("turn").alias("least"), F.count("*").alias("rows"), F.count("turn").alias("dated")).where("rows > 1")
    later = F.col("rows").isNotNull() & ~F.when(F.col("dated") < F.col("rows"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", "b").when(later, "d").when(end.endswith(".") | end.endswith("!") | end.endswith("?"), ".").otherwise("t")
    initial = F.substring("role", 1, 1)
    symbol = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)
    marked = each.join(seen, ["key", "role", "text"], "left").select("key", "turn", "role", "text", "n", symbol.alias("symbol"))
    order = ["key", "turn", "role", "text"]
    return durable(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()))


def _arrow(rows: Iterable[pa.RecordBatch], body, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """body(row) gives a tuple for each row, in order."""
    for batch in rows:
        made = [body(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        columns = list(zip(*made, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _matrices(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _arrow(rows, lambda key, seg, symbols: (key, seg, transfers(symbols)), ["key", "seg", "m"], [pa.string(), pa.int64(), pa.list_(pa.int64())])


def _suffixes(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rows: key, seg, m, last; sorted by key and descending seg."""
    after: tuple[int, ...] = ()

    def body(key: str, seg: int, m: list[int], last: bool) -> tuple:
        nonlocal after
        here = None if last else after
        # at the end only turns can be inserted
        then = Segment("", None).costs() if last else after
        after = tuple(min(NEVER, min(m[4 * q + r] + then[r] for r in range(4))) for q in range(4))
        return key, seg, here

    return _arrow(rows, body, ["key", "seg", "after"], [pa.string(), pa.int64(), pa.list_(pa.int64())])


def with_copies(plan: tuple[str, ...], copies: list[int]) -> str:
    """The audit of a segment whose rows stand there `copies` times: a D for each further one, right after the first, as no initial is less."""
    out = []
    for edits, n in zip(plan, copies, strict=True):
        before, _, after = edits.partition("|")
        inserted = len(before) - (1 if before[-1] in "DK" else 2)
        out.append("I" * inserted + before[inserted] + "D" * (n - 1) + "I" * len(after))
    return "".join(out)


def _traces(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def body(key: str, seg: int, at: int, symbols: str, copies: list[int], first: bool, last: bool, after: list[int] | None) -> tuple:
        found = solved(symbols, tuple(after) if after else None, first)
        more = sum(copies) - len(copies)
        audits = ["" if t is None else with_copies(t.plan, copies) if more else t.audit for t in found]
        costs = [0 if t is None else t.cost + DELETE * more for t in found]
        ends, plans = [START if t is None else t.end for t in found], [() if t is None else t.plan for t in found]
        return key, seg, at, first, first and last, symbols[0], symbols[-2], illegal_pairs(symbols) + more, costs, audits, ends, plans

    names = ["key", "seg", "at", "first", "alone", "head", "tail", "illegal", "costs", "audits", "ends", "plans"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.string()))]
    return _arrow(rows, body, names, kinds)


def _entries(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rows: key, seg, first, head, tail, ends; sorted by key and seg."""
    state, before = START, ""

    def body(key: str, seg: int, first: bool, head: str, tail: str, ends: list[int]) -> tuple:
        nonlocal state, before
        entry = START if first else state
        broken = not first and before + head not in LEGAL
        state, before = ends[entry], tail
        return key, seg, entry, int(broken)

    return _arrow(rows, body, ["key", "seg", "entry", "broken"], [pa.string(), pa.int64(), pa.int32(), pa.int64()])


def _scanned(df: DataFrame, *order) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key", *order)


def solve(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """key, seg, at (first seq), cost, audit, plan and illegal (adjacent pairs) of every segment. rows: numbered()."""
    marked = rows.select("key", F.call_function("div", "seq", F.lit(segment)).alias("seg"), F.struct("seq", "symbol", "n").alias("row"))
    held = marked.groupBy("key", "seg").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    held = durable(held.select("key", "seg", F.col("rows")[0]["seq"].alias("at"), F.array_join("rows.symbol", "").alias("symbols"), F.col("rows.n").alias("copies")))
    ends = held.groupBy("key").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"))
    placed = held.join(ends, "key").select("key", "seg", "at", "symbols", "copies", (F.col("seg") == F.col("lo")).alias("first"), (F.col("seg") == F.col("hi")).alias("last"))
    parts = durable(placed)
    long = parts.where("NOT (first AND last)")
    crossing = long.select("key", "seg", "symbols").mapInArrow(_matrices, "key string, seg bigint, m array<bigint>")
    follows = _scanned(crossing.join(long.select("key", "seg", "last"), ["key", "seg"]), F.desc("seg")).mapInArrow(_suffixes, "key string, seg bigint, after array<bigint>")
    schema = "key string, seg bigint, at bigint, first boolean, alone boolean, head string, tail string, illegal bigint, costs array<bigint>, audits array<string>, ends array<int>, plans array<array<string>>"
    traced = durable(parts.join(follows, ["key", "seg"], "left").select("key", "seg", "at", "symbols", "copies", "first", "last", "after").mapInArrow(_traces, schema))
    entries = _scanned(traced.where("NOT alone").select("key", "seg", "first", "head", "tail", "ends"), "seg").mapInArrow(_entries, "key string, seg bigint, entry int, broken bigint")
    way = F.coalesce("entry", F.lit(START))
    chosen = traced.join(entries, ["key", "seg"], "left")
    return durable(chosen.select("key", "seg", "at", F.get("costs", way).alias("cost"), F.get("audits", way).alias("audit"), F.get("plans", way).alias("plan"), (F.col("illegal") + F.coalesce("broken", F.lit(0))).alias("illegal")))


class Repaired(NamedTuple):
    #: key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row for each conversation of `ids`.
    report: DataFrame
    #: key (as in the report), seq, part, role, text: the turns left, to be ordered by seq and part; inserted turns have empty texts.
    turns: DataFrame


def repair(rows: DataFrame, ids: DataFrame | None = None, segment: int = SEGMENT) -> Repaired:
    """Repairs conversations (conv_id, turn, role, text; copies if a column says how often a row stands there).

    ids: the conversations to report on, those of `rows` if None.
    """
    rows = rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1).cast("long"))
    known = (rows if ids is None else ids).select("conv_id").distinct().withColumn("key", _key())
    each = numbered(rows)
    segments = solve(each, segment)
    fault = F.substring("symbol", 2, 1)
    stats = each.groupBy("key").agg(
        F.coalesce(F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(fault == "b", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "d", F.col("n")).when(fault != "b", F.col("n") - 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(fault == "t", 1).otherwise(0)).alias("truncated"),
    )
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "")
    edited = segments.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), pieces.alias("audit"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    report = known.join(stats, "key", "left").join(edited, "key", "left").select("key", "conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"))

    planned = segments.select("key", "at", F.posexplode("plan").alias("pos", "plan")).where("plan NOT IN ('D', 'D|')").select((F.col("at") + F.col("pos")).alias("seq"), "plan")
    full = lambda x: F.when(x == "u", "user").otherwise("assistant")
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    added = lambda x: F.transform(F.array_remove(F.split(x, ""), ""), lambda r: turn(full(r), F.lit("")))
    edit = F.regexp_extract("plan", "(D|K|R[ua])", 1)
    own = F.when(edit == "K", F.array(turn(F.col("role"), F.col("text")))).when(edit == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(turn(full(F.substring(edit, 2, 1)), F.col("text"))))
    made = F.concat(added(F.regexp_extract("plan", "^[ua]*", 0)), own, added(F.regexp_extract("plan", r"\|([ua]*)$", 1)))
    turns = each.join(planned, "seq").select("key", "seq", F.posexplode(made).alias("part", "turn")).select("key", "seq", "part", "turn.role", "turn.text")
    return Repaired(report, turns)


def digests(turns: DataFrame) -> DataFrame:
    """key, repaired_sha256 of the turns' `role:text`, newline-joined. A conversation passes the hash row by row."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, names = None, hashlib.sha256(), ["key", "repaired_sha256"]
        for batch in rows:
            done: list[tuple[str, str]] = []
            for now, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in range(2)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=names)

    return _scanned(turns.select("key", "seq", "part", "role", "text"), "seq", "part").select("key", "role", "text").mapInArrow(run, "key string, repaired_sha256 string")


def damaged_and_repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The contract's columns: the report on every conversation after the contract's damage, with the digest of what is left."""
    found = repair(damage(conversations), conversations, segment)
    nothing = hashlib.sha256().hexdigest()
    return found.report.join(digests(found.turns), "key", "left").select(*(c for c in found.report.columns if c != "key"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The same rows in SQL, row by row: for every state the least (cost, audit) that leads there."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE crc AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) for i in range(256)] AS tab),
marked AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([ascii(x)::BIGINT for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')], lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM marked),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, {blanks}) AS body, left(role, 1) AS x,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS prev,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
faults AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS turns FROM faults GROUP BY conv_id),
edits(q, edit, x, q2, role) AS (VALUES (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL), (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (3, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL),
    (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (3, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant')),
inserts(q, k, q2, added) AS (VALUES (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''), (0, 1, 2, '/user:'), (1, 1, 2, '/user:'), (2, 1, 3, '/assistant:'), (3, 1, 2, '/user:'),
    (0, 2, 3, '/user:/assistant:'), (1, 2, 3, '/user:/assistant:'), (2, 2, 2, '/assistant:/user:')),
added AS (SELECT q, k, q2, replace(added, '/', chr(10)) AS added FROM inserts),
path AS (
  SELECT conv_id, 0 AS pos, q2 AS q, 2 * k AS c, repeat('I', k) AS a, added AS r FROM told, added WHERE q = 0
  UNION ALL
  SELECT conv_id, pos, q, c, a, r FROM (
    SELECT p.conv_id, p.pos + 1 AS pos, i.q2 AS q, p.c + 2 * k + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + (edit != 'D' AND fault = 'truncated')::INT AS c, p.a || edit || repeat('I', k) AS a,
        p.r || CASE WHEN edit = 'D' THEN '' ELSE chr(10) || coalesce(e.role, f.role) || ':' || f.text END || added AS r
    FROM path p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1
    JOIN edits e ON e.q = p.q AND (e.x IS NULL OR e.x = f.x) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate')) JOIN added i ON i.q = e.q2)
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY c, a) = 1),
best AS (SELECT p.conv_id, c, a, substr(r, 2) AS r FROM path p JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND p.pos = t.turns WHERE q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY c, a) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(c, 0)::BIGINT AS cost, coalesce(a, '') AS audit, sha256(coalesce(r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""
