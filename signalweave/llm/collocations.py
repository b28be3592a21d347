"""Phrase collocation mining over sorted count streams.

Texts fall into pieces at punctuation and line ends, and pieces into words; a
phrase lies in one piece.  Its parts can only be as frequent or more so, which
gives the order of work:

1. Words are counted, each named by a 64-bit hash from here on; two words of one
   hash are found by the count, which then starts anew with other hashes.
2. Pairs of words are counted by hash alone, and the frequent ones marked in a
   bitmap of bounded size.  A mark too many costs work and changes nothing.
3. Pairs that are marked, and triples of which both pairs are, are counted
   exactly, by the hashes of all their words.

What is frequent forms three count streams.  Each is put in prefix order (by its
first words) and in suffix order (by its last), and streams of neighbouring
lengths walk in step: in prefix order a phrase meets the count of its head and
its longer ones, in suffix order the count of its tail and the others that
contain it.  These are sort-merge joins, and no table of counts is held in
memory.

Counts are of all texts; nothing is sampled or capped but the bitmap, which
passes more where it is full.  Scores are exact in decimals of 38 digits, for
counts of up to 15 digits.

Null text is empty; a null lang is ``und``, one with documents of that name.  A
lang without candidates has no row; an empty table gives none.  Rows that repeat
count again.  Texts of any length are taken whole; a task holds the largest a few
times.  Of the columns only text and lang are read, whatever the others are
called.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweave.llm.store import discard, materialize, sent
from signalweave.llm.text import Words, mixed, signed, slices

LEAST = 10
TOP = 2000
#: Share of a phrase's occurrences, in percent, within one longer candidate from which on it is dropped.
COVERED = 50
#: Bits of the bitmap for a frequent pair, and the bounds of its size as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 29
#: Text that is counted in one step, in bytes.
STEP_BYTES = 4 << 20

_PIECE, _PARTING = np.zeros(256, bool), np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PARTING[[0x20, 0x09]] = True
_PARTING |= _PIECE
_LANG_STEP, _WORD_STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


class Phrases:
    """The words of several texts: hash and language of each, and whether the next one follows in the same piece."""

    def __init__(self, texts: list[bytes], langs: list[str], salt: int):
        self.words = words = Words(texts, lower=True, parting=_PARTING)
        if salt:
            self.hashes = np.array([xxhash.xxh3_64_intdigest(words.codes[a:b].tobytes(), seed=salt) for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True)], np.uint64)
        else:
            self.hashes = words.hashes()
        self.hashes[self.hashes == 0] = 1  # 0 stands for no word
        ends = np.cumsum(_PIECE[words.codes])
        self.follows = np.zeros(len(words.first), bool)
        self.follows[:-1] = ends[words.first[1:]] == ends[words.last[:-1] - 1]
        self.names, of_text = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = np.repeat(of_text, np.diff(words.bounds))
        self.salts = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.names], np.uint64)

    def pairs(self) -> np.ndarray:
        """A hash of each word with the next and the language, whether or not that follows."""
        after = np.append(self.hashes[1:], np.uint64(0))
        with np.errstate(over="ignore"):
            return mixed(mixed(self.hashes * _WORD_STEP + after) + self.salts[self.lang] * _LANG_STEP)

    def lang_names(self, at: np.ndarray) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(self.lang[at].astype(np.int32)), pa.array(self.names.tolist(), pa.string())).cast(pa.string())


def _scan(docs: DataFrame, salt: int, found, schema: str) -> DataFrame:
    """Runs ``found`` on the phrases of every slice of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in slices(batch, limit=STEP_BYTES):
                yield found(Phrases(raws, part.column(0).to_pylist(), salt))

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, schema)


def _words(docs: DataFrame, salt: int) -> DataFrame:
    """lang, w, word, f, other: each word with its hash and count; ``other`` differs from ``word`` where two have one hash."""

    def found(p: Phrases) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            _, at, n = np.unique(mixed(p.hashes + p.salts[p.lang] * _LANG_STEP), return_index=True, return_counts=True)
        texts = [p.words.codes[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(p.words.first[at].tolist(), p.words.last[at].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([p.lang_names(at), pa.array(signed(p.hashes[at])), pa.array(texts, pa.string()), pa.array(n.astype(np.int64))], names=["lang", "w", "word", "n"])

    counted = _scan(docs, salt, found, "lang string, w bigint, word string, n bigint")
    return counted.groupBy("lang", "w").agg(F.min("word").alias("word"), F.sum("n").alias("f"), F.max("word").alias("other"))


def _frequent_pairs(docs: DataFrame, salt: int, least: int) -> DataFrame:
    """p: hashes of pairs that come ``least`` times or more; others of the same hash add to them."""

    def found(p: Phrases) -> pa.RecordBatch:
        pairs, n = np.unique(p.pairs()[p.follows], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(pairs)), pa.array(n.astype(np.int64))], names=["p", "n"])

    return _scan(docs, salt, found, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("p")


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """Words of 64 bits in which the place of each pair is set, made by the tasks; at most 2**MOST_BITS bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * pairs.count()).bit_length()))
    place = F.col("p").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    filled = pairs.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[filled.column("at").to_numpy()] = filled.column("bits").to_numpy()
    return out.view(np.uint64)


def _phrases(docs: DataFrame, salt: int, bitmap: np.ndarray, least: int) -> DataFrame:
    """lang, x, y, z, f: pairs (z = 0) and triples with their counts, of ``least`` and more."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def found(p: Phrases) -> pa.RecordBatch:
        marks = shared.value
        pairs = p.pairs()
        places = pairs & np.uint64(64 * len(marks) - 1)
        known = p.follows & ((marks[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63)) & np.uint64(1)) == 1)
        two = np.flatnonzero(known)
        three = two[np.append(known[1:], False)[two]]
        zero = np.zeros(len(two), np.uint64)
        first = np.concatenate([two, three])
        third = np.concatenate([zero, p.hashes[three + 2]])
        second = p.hashes[first + 1]
        with np.errstate(over="ignore"):
            keys = mixed(mixed(pairs[first] + _WORD_STEP) + third)
        _, at, which, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        same = at[which]
        if not (np.array_equal(p.hashes[first], p.hashes[first][same]) and np.array_equal(second, second[same]) and np.array_equal(third, third[same]) and np.array_equal(p.lang[first], p.lang[first][same])):
            at, n = np.arange(len(first)), np.ones(len(first), np.int64)  # two phrases of one hash: all go on singly
        arrays = [p.lang_names(first[at]), *[pa.array(signed(x)) for x in (p.hashes[first][at], second[at], third[at])], pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "x", "y", "z", "n"])

    counted = _scan(docs, salt, found, "lang string, x bigint, y bigint, z bigint, n bigint")
    return counted.groupBy("lang", "x", "y", "z").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exactly."""
    wide = lambda c: c.cast("decimal(15,0)")
    over = F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a))
    return F.call_function("div", over, wide(l) * wide(r))


def _in_step(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Both streams are sorted by ``on`` and walked together."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def mine(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``top`` phrases of two or three words.

    ``a`` is a phrase's count, ``l`` and ``r`` those of its parts at the cut of
    the lowest score, ``n`` the number of the lang's words.  A phrase that lies
    within a longer candidate for ``covered`` percent of its occurrences is left out.
    """
    for salt in itertools.count():
        words = materialize(_words(docs, salt), "words")
        if words.where(F.col("word") != F.col("other")).isEmpty():
            break
        discard(words)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    pairs = materialize(_frequent_pairs(docs, salt, least), "pairs")
    bitmap = _bitmap(pairs)
    discard(pairs)
    phrases = materialize(_phrases(docs, salt, bitmap, least), "phrases")

    one = words.where(F.col("f") >= least).select("lang", "w", "word", "f")
    two = phrases.where(F.col("z") == 0).select("lang", "x", "y", F.col("f").alias("a"))
    three = phrases.where(F.col("z") != 0).select("lang", "x", "y", "z", F.col("f").alias("a"))
    # Pairs meet the words they begin with in prefix order, and those they end with in suffix order.
    two = _in_step(two, one.select("lang", F.col("w").alias("x"), F.col("word").alias("wx"), F.col("f").alias("fx")), ["lang", "x"])
    two = materialize(_in_step(two, one.select("lang", F.col("w").alias("y"), F.col("word").alias("wy"), F.col("f").alias("fy")), ["lang", "y"]), "pairs")
    # Triples meet their first pair in prefix order, and their last pair in suffix order.
    heads = two.select("lang", "x", "y", F.col("a").alias("fxy"), "wx", "fx", "wy")
    tails = two.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("fyz"), F.col("wy").alias("wz"), F.col("fy").alias("fz"))
    joined = _in_step(_in_step(three, heads, ["lang", "x", "y"]), tails, ["lang", "y", "z"])
    early, late = _score(F.col("a"), F.col("fx"), F.col("fyz")), _score(F.col("a"), F.col("fxy"), F.col("fz"))
    pick = early <= late
    longer = joined.select("lang", F.concat_ws(" ", "wx", "wy", "wz").alias("phrase"), "a", F.when(pick, F.col("fx")).otherwise(F.col("fxy")).alias("l"), F.when(pick, F.col("fyz")).otherwise(F.col("fz")).alias("r"), F.least(early, late).alias("score"))
    # The most frequent extension of a pair, to the right in prefix order and to the left in suffix order.
    right = three.groupBy("lang", "x", "y").agg(F.max("a").alias("to_right"))
    left = three.groupBy("lang", F.col("y").alias("x"), F.col("z").alias("y")).agg(F.max("a").alias("to_left"))
    extended = _in_step(_in_step(two, right, ["lang", "x", "y"], "left"), left, ["lang", "x", "y"], "left")
    most = F.greatest(F.coalesce("to_right", F.lit(0)), F.coalesce("to_left", F.lit(0)))
    kept = extended.where(100 * most < covered * F.col("a"))
    shorter = kept.select("lang", F.concat_ws(" ", "wx", "wy").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), _score(F.col("a"), F.col("fx"), F.col("fy")).alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = shorter.unionByName(longer).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(sent(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d)),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p) CROSS JOIN (VALUES (1), (2), (3)) AS v(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, a FROM f WHERE k > 1 AND a >= {least}),
s AS (
  SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s) WHERE o = 1),
x AS (
  SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE 100 * coalesce(most, 0) < {covered} * b.a)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM r JOIN t USING (lang) WHERE rank <= {top}
"""
