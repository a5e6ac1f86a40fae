"""Fuzzy line dedup by SimHash and pigeonhole blocks, in built-in functions only.

1. Lines (split at newlines) are normalised: lower case, digits to 0, other runs than letters and digits to one space. Lines with
   nothing left are no candidates and always stay. Lines with equal normal forms are one class from the start.
2. A line's features are its words (a word of under 4 letters together with the next one) or, up to 24 characters, its pairs of
   characters (lines of up to 30 have a fingerprint of either kind). Their hashes deal them to BLOCKS groups, and a block of the fingerprint is the
   SimHash of one group: bit by bit the majority of the hashes of its VOTES smallest features. In a SimHash over the whole line one
   edit stirs every bit; here it stirs the few groups that hold the features it takes and gives, and most edits of long lines stir none.
3. Lines that agree on SHARED blocks (not the empty ones) are candidates. They are found by joins on the blocks.
4. Candidates are verified by edit similarity, at least SIMILARITY: of the characters of the normal forms, or of their words (compared
   by 20-bit hashes) where the longer one has over LONG characters.
5. Of each connected group of lines, the first occurrence (smallest doc_id, then line number) stays.

A block that more than CROWD classes share is not paired out. All are verified against its smallest member; those that are
similar hang together by it. What is left meets the others again under two blocks, and where these are crowded too under three; as
candidates share three blocks, no pair is lost. Only lines that share three blocks with a crowd, and are not like its smallest
member, are held against all of it: after LEADERS more leaders, and only
against lines that nothing links them to yet and that lengths and parities (of words, or pairs of characters) allow to be similar.

Defined results: a null text stays null, an empty one empty. A removed line goes with its newline. Rows without a doc_id stay as they
are, and their lines count for nothing. Rows of one doc_id and one text are copies of one document: what goes from one goes from all, and none is a
duplicate of the other; rows of one doc_id and different texts are documents of their own, in the order of their texts' hashes. Ties
cannot arise: an occurrence is told by doc_id, text and line. Empty tables give empty results. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, let
from .components import connected_components

SIMILARITY, BLOCKS, VOTES, SHARED, CROWD = 0.8, 8, 3, 3, 12
#: Characters up to which features are pairs of characters; from which words are compared.
SHORT, LONG = 24, 100
#: Letters from which a word is a feature by itself.
WORD = 4
#: First hashes of the groups that features are dealt to.
EDGES = [-(1 << 63) + (1 << 64) * j // BLOCKS for j in range(BLOCKS)]
#: Numbers of 64 bits in a parity; leaders that the last level of crowds tries before all are compared.
PARITY, LEADERS = 4, 2
BANDS = (4, 16, 64, 250, 1000, 4000, 16000)
#: Documents with candidates up to this number are broadcast (by id and hash).
BROADCAST_IDS = 200_000


def normal_lines(text: Column) -> Column:
    """The normal forms of a text's lines, as many as the text has lines."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{N}", "0"), r"[^\p{L}0\n]+", " ")
    return F.split(plain, "\n")


def _votes(own: str, short: bool) -> list[Column]:
    """The blocks of a line as keys; null for an empty block. own: column of its features' hashes, sorted, with EDGES, whose places are own0, own1, ..."""

    def vote(j: int) -> Column:
        at, n = F.col(f"{own}{j}"), F.col(f"{own}{j + 1}") - F.col(f"{own}{j}") - 1
        # of two hashes those bits that both have, of one its own: the majority with a 0 or itself
        a, b, c = F.get(own, at), F.get(own, F.when(n < 2, at).otherwise(at + 1)), F.when(n < VOTES, F.lit(0).cast("long")).otherwise(F.get(own, at + 2))
        return F.when(n > 0, F.xxhash64(F.lit(short), F.lit(j), F.least(n, F.lit(VOTES)), a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseOR(b)))))

    return [vote(j) for j in range(BLOCKS)]


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), line, h (hash of the normal form) and keys (of its blocks) of every line that has a word.

    keys has none where nothing but equal lines are similar. The columns are made one by one, so that all but the features' hashes is compiled.
    """
    held = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    each = held.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(normal_lines(F.col("text"))).alias("line", "norm"))
    told = each.select("doc_id", "t", "line", F.trim("norm").alias("norm")).where("norm != ''").select("doc_id", "t", "line", "norm", F.xxhash64("norm").alias("h"), F.length("norm").alias("n"))
    able = F.col("n") * (1 - SIMILARITY) >= 1
    by_word = told.withColumn("w", F.when(able & (F.col("n") > SHORT), F.split("norm", " ")))
    by_pair = by_word.withColumn("p", F.when(able & (F.col("n") * SIMILARITY <= SHORT), F.concat(F.lit(" "), "norm", F.lit(" "))))
    word = F.transform("w", lambda x, i: F.when(F.length(x) >= WORD, F.xxhash64(x)).otherwise(F.xxhash64(x, F.get("w", i + 1))))
    pair = F.transform(F.sequence(F.lit(1), F.length("p") - 1), lambda i: F.xxhash64(F.substring("p", i, F.lit(2))))
    # sorted together with the first hashes of the groups, which show where each begins
    own = lambda features: F.sort_array(F.array_distinct(F.concat(features, F.array(*map(F.lit, EDGES)))))
    sets = by_pair.select("doc_id", "t", "line", "h", own(word).alias("w"), own(pair).alias("p"))
    place = lambda c, j: F.array_position(c, F.lit(EDGES[j])).cast("int") if j < BLOCKS else F.size(c) + 1
    places = sets.select("*", *(place(c, j).alias(f"{c}{j}") for c in ("w", "p") for j in range(BLOCKS + 1)))
    return places.select("doc_id", "t", "line", "h", F.array_compact(F.array(*_votes("w", False), *_votes("p", True))).alias("keys"))


def _edits(a: Column, b: Column, least: float) -> Column:
    """1 - edit distance / longer length is at least `least`."""
    allowed = F.floor((1 - least) * F.greatest(F.length(a), F.length(b)) + 1e-9).cast("int")
    # Spark's levenshtein() takes a constant bound, and works in a band of that width. Most pairs are a few edits apart: narrow
    # bands come first, and a wider one only where the pair may need it
    found = F.levenshtein(a, b) <= allowed
    for band in reversed(BANDS):
        at = F.levenshtein(a, b, band)
        found = F.when(at >= 0, at <= allowed).when(allowed <= band, F.lit(False)).otherwise(found)
    return F.when(F.abs(F.length(a) - F.length(b)) > allowed, F.lit(False)).otherwise(found)


def word_symbols(norm: Column) -> Column:
    """A string of one character for each word, by the word's hash."""
    code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(1 << 20)) + (1 << 16)), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " "), code), "")), "UTF-32")


def _odd(hashes: Column) -> Column:
    """PARITY numbers of 64 bits: a bit for each of as many buckets, set if an odd number of hashes falls there."""
    own = lambda x, q: x.bitwiseAND(F.lit(PARITY - 1)) == q
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x, 8), F.lit(64)).cast("int"))
    part = lambda all_, q: F.aggregate(all_, F.lit(0).cast("long"), lambda s, x: F.when(own(x, q), s.bitwiseXOR(bit(x))).otherwise(s))
    return let(hashes, lambda all_: F.struct(*(part(all_, q).alias(f"q{q}") for q in range(PARITY))))


def forms(norm: Column) -> Column:
    """What lines are compared by: their length n, chars (null if long) and words; w, the number of words, and parities of words and of pairs of characters."""
    n = F.length(norm)
    pairs = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.substring(F.concat(F.lit(" "), norm, F.lit(" ")), i + 1, F.lit(2))))
    # by the same 20 bits as the words' symbols
    words = F.transform(F.split(norm, " "), lambda w: F.xxhash64(F.pmod(F.xxhash64(w), F.lit(1 << 20))))
    return F.struct(n.alias("n"), F.when(n <= LONG, norm).alias("chars"), word_symbols(norm).alias("words"), F.size(words).alias("w"), _odd(words).alias("odd_words"), F.when(n <= LONG, _odd(pairs)).alias("odd_pairs"))


def may_be_similar(a: Column, b: Column, least: float = SIMILARITY) -> Column:
    """False only where similar() is false, by lengths and parities alone: an edit of a word changes two buckets at most, one of a character four."""
    long = F.greatest(a["n"], b["n"]) > LONG
    la, lb = (F.when(long, x["w"]).otherwise(x["n"]) for x in (a, b))
    allowed = F.floor((1 - least) * F.greatest(la, lb) + 1e-9)
    apart = lambda of: sum((F.bit_count(a[of][f"q{q}"].bitwiseXOR(b[of][f"q{q}"])) for q in range(PARITY)), F.lit(0))
    return (F.abs(la - lb) <= allowed) & F.when(long, apart("odd_words") <= 2 * allowed).otherwise(apart("odd_pairs") <= 4 * allowed)


def similar(a: Column, b: Column, least: float = SIMILARITY) -> Column:
    """Edit similarity of two lines, given by forms(), is at least `least`: by words if the longer one has over LONG characters."""
    return F.when(F.greatest(a["n"], b["n"]) <= LONG, _edits(a["chars"], b["chars"], least)).otherwise(_edits(a["words"], b["words"], least))


def _texts(docs: DataFrame, at: DataFrame) -> DataFrame:
    """h and form of the classes in `at` (h, doc_id, t, line), each read from the occurrence named there."""
    wanted = durable(at.groupBy("doc_id", "t").agg(F.collect_list(F.struct("line", "h")).alias("want")))
    if wanted.count() <= BROADCAST_IDS:
        ids = wanted.select("doc_id", "t")
        held = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(F.broadcast(ids), ["doc_id", "t"], "left_semi")
    else:
        held = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    picked = F.transform("want", lambda x: F.struct(x["h"].alias("h"), F.trim(F.get(normal_lines(F.get(F.split("text", "\n"), x["line"])), F.lit(0))).alias("norm")))
    return durable(held.dropDuplicates(["doc_id", "t"]).join(wanted, ["doc_id", "t"]).select(F.explode(picked).alias("p")).select("p.h", forms(F.col("p.norm")).alias("form")))


def _sized(rows: DataFrame) -> DataFrame:
    """key, h and n, the classes of the key; keys of one class left out."""
    return durable(rows.select("key", "h").withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select("key", "h").join(rows.select("key", F.col("h").alias("o")), "key").where("h < o").select(F.col("h").alias("a"), F.col("o").alias("b"))


def _links(pairs: DataFrame, keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b that share SHARED blocks and are similar."""
    side = lambda name, df, old, new: df.select(F.col("h").alias(name), F.col(old).alias(new))
    near = pairs.join(side("a", keyed, "keys", "k"), "a").join(side("b", keyed, "keys", "l"), "b").where(F.size(F.array_intersect("k", "l")) >= SHARED).select("a", "b")
    return durable(near.join(side("a", texts, "form", "x"), "a").join(side("b", texts, "form", "y"), "b").where(may_be_similar(F.col("x"), F.col("y")) & similar(F.col("x"), F.col("y"))).select("a", "b"))


def _all(several: list[DataFrame]) -> DataFrame:
    every = several[0]
    for more in several[1:]:
        every = every.unionByName(more)
    return every


def _last_level(crowded: DataFrame, rest: DataFrame, out: list[DataFrame], within: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: pairs that connect what `out` connects, and the crowds of one path (crowded: key, h). rest: key and o, the members unlike their leader.

    More leaders are tried, each on those that no leader before is like. Then only lines that are not connected yet are compared, and of these
    only those whose lengths and parities allow it.
    """
    left = rest
    for _ in range(LEADERS):
        led = left.join(left.groupBy("key").agg(F.min("o").alias("a")), "key").where("o != a")
        alike = _links(led.select("a", F.col("o").alias("b")).distinct(), within, texts)
        out.append(alike)
        left = durable(led.join(alike.withColumnRenamed("b", "o"), ["a", "o"], "left_anti").select("key", "o"))
    found = durable(connected_components(_all(out)))
    told = durable(texts.join(crowded.select("h").distinct(), "h").join(found.withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("component", "h").alias("c"), F.col("form").dropFields("chars", "words").alias("f")))
    ours = rest.join(told.select(F.col("h").alias("o"), F.col("c").alias("d"), F.col("f").alias("g")), "o")
    theirs = crowded.select("key", "h").join(rest.select("key", F.col("o").alias("h"), F.lit(True).alias("too")), ["key", "h"], "left").join(told, "h")
    # of two that are both unlike their leader, one meets the other
    unlinked = (F.col("c") != F.col("d")) & (F.col("o") != F.col("h")) & (F.col("too").isNull() | (F.col("o") < F.col("h")))
    met = durable(ours).join(durable(theirs), "key").where(unlinked & may_be_similar(F.col("f"), F.col("g")))
    others = met.select(F.least("o", "h").alias("a"), F.greatest("o", "h").alias("b")).distinct()
    return _all([found.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b")), _links(others, within, texts)])


def links(docs: DataFrame, found: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: pairs of classes that connect all lines which share SHARED blocks and are similar. found: lines()."""
    keyed = durable(found.where(F.size("keys") >= SHARED).dropDuplicates(["h"]))
    met = _sized(keyed.select("h", F.explode("keys").alias("key")))
    # a line that meets others under fewer blocks has no candidate
    able = durable(met.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") >= SHARED).select("h"))
    rows = _sized(met.join(able, "h"))
    within = durable(keyed.join(rows.select("h").distinct(), "h"))
    texts = _texts(docs, within.select("h", "doc_id", "t", "line"))
    within = within.select("h", "keys")
    # two blocks in common among those that are not crowded; a pair with fewer shares two crowded ones, and meets below
    twice = _pairs(rows.where(F.col("n") <= crowd)).groupBy("a", "b").agg(F.count("*").alias("m")).where("m > 1").select("a", "b")
    out = [_links(twice, within, texts)]
    named = rows.where(F.col("n") > crowd).select(F.array("key").alias("path"), "key", "h")
    for depth in range(1, SHARED + 1):
        crowded = durable(named)
        led = crowded.join(crowded.groupBy("key").agg(F.min("h").alias("a")), "key").where("h != a")
        alike = _links(led.select("a", F.col("h").alias("b")).distinct(), within, texts)
        out.append(alike)
        rest = durable(led.join(alike.withColumnRenamed("b", "h"), ["a", "h"], "left_anti").select("key", F.col("h").alias("o")))
        if depth == SHARED:
            return _last_level(crowded, rest, out, within, texts)
        # under one more block: those with something left, and the others that share that block with it
        deeper = lambda df: df.join(within, "h").select("h", "path", F.explode(F.array_except("keys", "path")).alias("k")).select("h", F.array_sort(F.concat("path", F.array("k"))).alias("path"))
        left = durable(deeper(crowded.join(rest.withColumnRenamed("o", "h"), ["key", "h"])).distinct())
        again = deeper(crowded.join(rest.select("key").distinct(), "key")).distinct().join(left.select("path").distinct(), "path")
        sized = durable(again.withColumn("key", F.xxhash64("path")).withColumn("n", F.count("*").over(Window.partitionBy("path"))).where("n > 1"))
        small = _pairs(sized.where(F.col("n") <= crowd)).distinct()
        out.append(_links(small, within, texts))
        named = sized.where(F.col("n") > crowd).select("path", "key", "h")


def duplicate_lines(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, t, line (from 0) of each line to remove."""
    found = durable(lines(docs))
    groups = durable(connected_components(links(docs, found, crowd)).select(F.col("node").alias("h"), "component"))
    classes = durable(found.groupBy("h").agg(F.min(F.struct("doc_id", "t", "line")).alias("at"), F.max(F.struct("doc_id", "t", "line")).alias("last")))
    # a line that is neither repeated nor in a group stays
    grouped = durable(classes.join(groups, "h", "left").where("component IS NOT NULL OR at != last").select("h", F.coalesce("component", "h").alias("group"), "at"))
    first = grouped.groupBy("group").agg(F.min("at").alias("first"))
    kept = durable(grouped.join(first, "group").select("h", "first"))
    return found.select("doc_id", "t", "line", "h").join(kept, "h").where(F.struct("doc_id", "t", "line") != F.col("first")).select("doc_id", "t", "line")


def line_dedup(docs: DataFrame, counts: bool = True) -> DataFrame:
    """docs with text deduplicated; with counts, n_lines and n_removed (0 for null texts) too, in place of columns of these names."""
    gone, t = fresh(docs, "gone"), fresh(docs, "t")
    spans = duplicate_lines(docs).groupBy("doc_id", F.col("t").alias(t)).agg(F.collect_set("line").alias(gone))
    joined = docs.withColumn(t, F.xxhash64("text")).join(durable(spans), ["doc_id", t], "left")
    split = F.split("text", "\n")
    rest = let(split, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col(gone)), lambda i: F.get(s, i)), "\n"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest)
    if not counts:
        return joined.withColumn("text", text).select(docs.columns)
    number = {
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long"),
        "n_removed": F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"),
    }
    others = [c for c in docs.columns if c not in (*number, "text")]
    out = joined.select(*others, *(v.alias(k) for k, v in number.items()), text.alias("text"))
    return out.select(*[c for c in docs.columns if c not in number], *number)
