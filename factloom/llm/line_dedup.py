"""Line dedup: an exact set-similarity join over the lines of all documents, in DataFrame operations only.

A line is its set of words (between spaces, tabs and other ASCII white space). A line goes if a line earlier in the
order of (``doc_id``, line number, hash of the text) has a Jaccard similarity of ``SIMILARITY`` or more with it, judged
on the input. Lines of fewer than ``least`` distinct words stay and aren't compared: ``LEAST`` by default, 1 in the query
and the pipeline, which judge every line with a word.

1. Lines of equal sets form a class, known by its first line; all others of a class go.
2. The words of a class are ordered by rarity (counts over all lines in ``SLOTS`` slots by hash, in steps of an eighth
   of a power of two, then by hash: one order for all lines). Two similar classes share a word of their prefixes, the
   first ``n - ceil(t * n) + 1`` words.
3. Classes meet at the words of their prefixes. A pair is a candidate if the lengths, the places of the shared word,
   and the parities of the words' hashes (64 bits, 256 for lines of over ``LONG`` words: each unshared word flips one)
   allow the similarity.
4. At each of its words, a class that may match the earliest class there is held against that one only, else against all
   earlier candidates, so a crowd of variants costs as much as its size. Candidates are verified with the whole sets: of
   each class first its likeliest one by parities and the earliest ones, then, for the classes that this leaves in place, all others, and those
   that were skipped for the earliest one.

The tables of slots that expressions look up are of a fixed size and travel in the plan. Words are compared by 64 bits
of hash (55 and the rarity in the order).

Cases: a null text has no lines, an empty one an empty line; lines with nothing but white space stay. Rows equal in
``doc_id`` and text count as one document, and each of them gets its result. A null id comes first. Only line feeds end
lines. All columns but the text pass through ``without_repeats``.
"""

from __future__ import annotations

import math
import struct
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialised

SIMILARITY, LEAST = 0.8, 5
#: Slots of the table of rarities, and bits of the tables that spare lines and words a move.
SLOTS, FLAGS = 1 << 18, 1 << 20
#: A line: its document, and its number with 32 bits of the text's hash, which tell rows that share an id apart.
_AT = ["doc", "at"]
#: Parities of all words and, in lines of over LONG words, of three quarters of them by hash (the fourth follows).
_PARITIES, LONG = ["parity", "parity1", "parity2", "parity3"], 96
_SPACES = "\t\r\x0b\x0c"


def _flags(values: DataFrame) -> Column:
    """A fixed table of ``FLAGS`` bits, those at the hashes in the one column of ``values`` set; it is made by executors."""
    bit = F.col("v").bitwiseAND(F.lit(FLAGS - 1))
    maps = values.toDF("v").groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit.bitwiseAND(F.lit(32767)) + 1)).alias("bits"))
    table = bytearray(FLAGS // 8)
    for part, found in maps.toLocalIterator():  # FLAGS / 32768 rows of 4 KB at most
        table[part * 4096 : (part + 1) * 4096] = found
    return F.split(F.lit(",".join(map(str, struct.unpack(f"<{FLAGS // 64}q", table)))), ",").cast("array<bigint>")


def _flagged(table: Column, value: Column) -> Column:
    bit = value.bitwiseAND(F.lit(FLAGS - 1))
    return F.getbit(F.get(table, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1


def _split_lines(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("hash"), F.split(text, "\n").alias("lines"))
    low = F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF))
    return d.select("doc", "hash", F.posexplode("lines").alias("line", "body")).select("doc", F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(low).alias("at"), "body")


def _split_words(body: Column) -> Column:
    """The line's words, and an empty one for each two spaces side by side."""
    odd = reduce(lambda a, b: a | b, [F.contains(body, F.lit(c)) for c in _SPACES])
    return F.split(F.when(odd, F.translate(body, _SPACES, " " * len(_SPACES))).otherwise(body), " ")


def _words(body: Column) -> Column:
    """Hashes of the line's distinct words."""
    return F.array_remove(F.array_distinct(F.transform(_split_words(body), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _rarity(lines: DataFrame) -> list[int]:
    """By slot of the words' hashes, a quarter of a binary logarithm's step of the count of words there, below 127."""
    slots = lines.select(F.explode(_split_words(F.col("body"))).alias("w")).groupBy(F.xxhash64("w").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).count()
    table = [0] * SLOTS
    for slot, n in slots.toLocalIterator():  # SLOTS rows at most
        table[slot] = min(126, int(4 * math.log2(n + 1)))
    return table


def _needed(a: Column, b: Column, t: float) -> Column:
    """The least overlap of sets of these sizes with the similarity ``t``."""
    return F.ceil((a + b) * (t / (1 + t)) - 1e-9)


def _apart(l: Column, r: Column) -> Column:
    """The words that only one of two lines has are at least so many."""
    count = lambda c: F.bit_count(l[c].bitwiseXOR(r[c]))
    rest = [reduce(lambda a, b: a.bitwiseXOR(b), (x[c] for c in _PARITIES)) for x in (l, r)]
    parts = sum((count(c) for c in _PARITIES[1:]), F.bit_count(rest[0].bitwiseXOR(rest[1])))
    long = (F.shiftright(l["np"], 32) > LONG) & (F.shiftright(r["np"], 32) > LONG)
    return F.when(long, parts).otherwise(count("parity"))


def _may_match(l: Column, r: Column, t: float) -> Column:
    """Whether parities, sizes and places of the shared word allow the similarity."""
    size = {k: F.shiftright(x["np"], 32) for k, x in (("l", l), ("r", r))}
    pos = {k: x["np"].bitwiseAND(F.lit(0xFFFFFFFF)) for k, x in (("l", l), ("r", r))}
    need = _needed(size["l"], size["r"], t)
    most = F.least(pos["l"], pos["r"]) + F.least(size["l"] - pos["l"], size["r"] - pos["r"])
    sizes = (size["r"] >= F.ceil(size["l"] * t - 1e-9)) & (size["l"] >= F.ceil(size["r"] * t - 1e-9))
    return (_apart(l, r) <= size["l"] + size["r"] - need * 2) & sizes & (most >= need)


def _before(l: Column, r: Column) -> Column:
    """Whether ``r`` comes before ``l``; a null id first."""
    same = r["doc"].eqNullSafe(l["doc"])
    return (same & (r["at"] < l["at"])) | (~same & (r["doc"].isNull() | (r["doc"] < l["doc"])))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.at") == F.col(f"{b}.at"))


def _verified(pairs: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """The later lines of those ``pairs`` (structs ``l`` and ``r``) that are similar."""
    ids = materialised(pairs.select("l.*").unionByName(pairs.select("r.*")).distinct())
    flags = _flags(ids.select(F.xxhash64("doc", "at")))
    # most other lines need not be moved
    lines = _split_lines(docs).where(_flagged(flags, F.xxhash64("doc", "at"))).alias("x").join(ids.alias("y"), _same("x", "y"), "left_semi")
    sets = materialised(lines.dropDuplicates(_AT).select(*_AT, _words(F.col("body")).alias("w")))
    first = pairs.select("l.doc", "l.at", "r").alias("p").join(sets.alias("x"), _same("p", "x")).select(F.struct("p.doc", "p.at").alias("l"), F.col("r.doc"), F.col("r.at"), F.col("w").alias("a"))
    both = first.alias("p").join(sets.alias("x"), _same("p", "x")).select("l", "a", F.col("w").alias("b"))
    return both.where(F.size(F.array_intersect("a", "b")) >= _needed(F.size("a"), F.size("b"), t)).select("l.*").distinct()


def removals(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """``doc``, ``at`` (the line number, and 32 bits of the text's hash below it) of each line that goes."""
    t = similarity
    raw = _split_lines(docs)
    table = F.split(F.lit(",".join(map(str, _rarity(raw)))), ",").cast("array<int>")  # small numbers, as plans that hold it are kept
    ranked = F.transform(_words(F.col("body")), lambda h: F.shiftleft(F.coalesce(F.get(table, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), F.lit(0)).cast("long"), 55).bitwiseOR(F.shiftrightunsigned(h, 9)))
    sets = raw.select("doc", "at", F.sort_array(ranked).alias("w"))
    n = F.size("w")
    flip = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))
    quarter = lambda k: F.when(n > LONG, flip(F.filter("w", lambda x: x.bitwiseAND(F.lit(192)) == 64 * k))).otherwise(F.lit(0).cast("long"))
    parities = [flip("w").alias("parity"), *(quarter(k).alias(c) for k, c in enumerate(_PARITIES[1:], 1))]
    prefix = F.slice("w", F.lit(1), (n - F.ceil(n * t - 1e-9) + 1).cast("int"))
    lines = materialised(sets.select("doc", "at", n.alias("n"), F.xxhash64("w").alias("h1"), F.hash("w").alias("h2"), *parities, prefix.alias("prefix")))
    judged = lines.where(F.col("n") >= max(1, least))  # not before, as Spark would then make the sets twice
    classes = materialised(judged.groupBy("h1", "h2", "n").agg(F.min(F.struct(*_AT)).alias("first"), *(F.first(c).alias(c) for c in (*_PARITIES, "prefix"))).drop("h1", "h2"))
    copies = materialised(judged.select(*_AT).distinct().alias("x").join(classes.select("first.*").alias("y"), _same("x", "y"), "left_anti"))
    discard(lines)
    spread = classes.select("first", "n", *_PARITIES, F.posexplode("prefix").alias("pos", "word"))
    np = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("np")
    rows = spread.select("word", F.struct(F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), np, *_PARITIES).alias("x"))
    pair = lambda x, name: F.struct(x["doc"].alias("doc"), x["at"].alias("at")).alias(name)

    # the struct is both ordered by and led by, so that this side and the other one read the same exchange
    led = rows.withColumn("lead", F.first("x").over(Window.partitionBy("word").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    led = led.select("word", "x", F.struct(F.col("lead.doc").alias("doc"), F.col("lead.at").alias("at")).alias("lead"), (_before(F.col("x"), F.col("lead")) & _may_match(F.col("x"), F.col("lead"), t)).alias("star"))
    l, r = F.col("l.x"), F.col("r.x")
    is_lead = F.col("l.lead.doc").eqNullSafe(r["doc"]) & (F.col("l.lead.at") == r["at"])
    joined = led.alias("l").join(rows.alias("r"), (F.col("l.word") == F.col("r.word")) & F.when(F.col("l.star"), is_lead).otherwise(_may_match(l, r, t) & _before(l, r)))
    tried = materialised(joined.select(pair(l, "l"), pair(r, "r"), F.col("l.star").alias("star"), _apart(l, r).alias("apart")).groupBy("l", "r").agg(F.max("star").alias("star"), F.min("apart").alias("apart")))
    # of each line its likeliest pair, and those with the earliest: most of the lines that go need no other
    likeliest = tried.groupBy("l").agg(F.min(F.struct("apart", "r")).alias("x")).select("l", "x.r")
    likeliest = materialised(likeliest.unionByName(tried.where("star").select("l", "r")).distinct())
    gone = materialised(_verified(likeliest, docs, t))

    left = materialised(tried.select("l.*", "r", "star").alias("x").join(gone.alias("g"), _same("x", "g"), "left_anti").select(pair(F.struct("doc", "at"), "l"), "r", "star"))
    rest = left.select("l", "r")
    # classes still in place that were held against the earliest only, at some word
    open_ = materialised(left.where("star").select("l.*").distinct())
    if not open_.isEmpty():
        flags = _flags(open_.select(F.xxhash64("doc", "at")))
        some = rows.where(_flagged(flags, F.xxhash64("x.doc", "x.at"))).join(open_.alias("o"), _same("x", "o"), "left_semi")
        some = materialised(some)
        words = _flags(some.select("word"))
        again = some.alias("l").join(rows.where(_flagged(words, F.col("word"))).alias("r"), (F.col("l.word") == F.col("r.word")) & _may_match(l, r, t) & _before(l, r))
        rest = rest.unionByName(again.select(pair(l, "l"), pair(r, "r")))
    rest = materialised(rest.distinct().exceptAll(likeliest))
    if not rest.isEmpty():
        gone = gone.unionByName(materialised(_verified(rest, docs, t)))

    discard(classes)
    return copies.unionByName(gone)


def decisions(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_lines``, ``removed`` (sorted line numbers from 0) for each different row of ``docs``."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines")).distinct()
    low = F.col("text_hash").bitwiseAND(F.lit(0xFFFFFFFF))
    gone = removals(docs, similarity, least).groupBy("doc", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low")).agg(F.array_sort(F.collect_set(F.shiftright("at", 32).cast("int"))).alias("removed"))
    none = F.array().cast("array<int>")
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("doc")) & (low == F.col("low")), "left")
    return joined.select("doc_id", "text_hash", "n_lines", F.coalesce("removed", none).alias("removed"))


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """``docs`` with the lines taken out of ``text``; a null text stays null."""
    found = decisions(docs, similarity, least).where(F.size("removed") > 0)
    text = F.col("d.text").cast("string")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("f.removed", i)), "\n")
    joined = docs.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(text) == F.col("f.text_hash")), "left")
    return joined.select(*(F.when(F.col("f.removed").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))
