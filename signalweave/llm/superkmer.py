"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words.  Its minimiser is the least hash of the
runs of ``m`` words inside it; neighbouring windows mostly share theirs, so a
text falls into stretches of windows, super-k-mers, that each go to the bucket
of one minimiser as one packed string of words.  Equal windows have equal
minimisers and so meet in one bucket, where sorting their hashes brings equal
windows together and tells the smallest doc_id that each starts in.

1. Minimisers are counted first, a few bytes a super-k-mer; one that a single
   document has cannot repeat elsewhere and its strings never travel.
2. The other super-k-mers travel packed.  A bucket with more than
   ``BUCKET`` of them is dealt to sub-buckets by document: within each, every
   window but the one of the smallest document is settled, and what remains
   open goes on as single window hashes, grouped by hash with pre-aggregation.
3. The windows found to repeat, as ranges of word positions, meet the texts,
   and the words they cover go.

Window hashes have 128 bits.  Null text has no words; texts of fewer than ``k``
words keep all; rows with equal doc_id do not remove words of each other, and
their windows are judged by text, so equal rows give equal results.  A null
doc_id counts as larger than all others.  An empty table gives an empty result.
Of the columns only doc_id, text and those named by ``keep`` are read, whatever
the others are called.  Texts of any length are taken whole; a task holds the
largest of them a few times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.store import discard, materialize, scratch
from signalweave.llm.text import STEP, Words, gram_hashes, mixed, signed, slices, sliding_min

K = 50
M = 8
#: Super-k-mers of one minimiser that stay together.
BUCKET = 1000
LAST = 2**63 - 1

_SALT = np.uint64(0xD6E8FEB86659FD93)


def super_kmers(words: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """minimiser, text, first word (among all words) and number of windows of each super-k-mer of the texts."""
    inside = np.flatnonzero(words.windows(k))
    if not len(inside):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    least = sliding_min(gram_hashes(words.hashes(), m), k - m + 1)[inside]
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.maximum(np.diff(words.bounds) - k + 1, 0))
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
    return least[first], owner[first], inside[first], np.diff(np.append(first, len(least)))


def window_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window that lies in one text."""
    hashes, inside = words.hashes(), words.windows(k)
    with np.errstate(over="ignore"):
        return gram_hashes(hashes, k)[inside], gram_hashes(mixed(hashes ^ _SALT) * STEP, k)[inside]


def _minimisers(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(mini, doc_key): a row for each super-k-mer of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in slices(batch):
                mini, owner, _, _ = super_kmers(Words(raws), k, m)
                if len(mini):
                    keys = part.column(0).to_numpy()[owner]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(mini)), pa.array(keys)], names=["mini", "doc_key"])

    return docs.select("doc_key", "text").mapInArrow(run, "mini bigint, doc_key bigint")


def _packed(wanted: DataFrame, k: int, m: int) -> DataFrame:
    """Super-k-mers of the wanted minimisers: (mini, sub, doc_key, row, start, words).

    ``wanted``: doc_key, text, minis (array of mini and number of sub-buckets), row (hash of the text).
    ``words`` is the piece of the text that the windows cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in slices(batch):
                words = Words(raws)
                mini, owner, first, count = super_kmers(words, k, m)
                asked = part.column(2).flatten()
                known, at = np.unique(asked.field(0).to_numpy(), return_index=True)
                subs = asked.field(1).to_numpy()[at]
                place = np.minimum(np.searchsorted(known, signed(mini)), len(known) - 1)
                taken = np.flatnonzero(known[place] == signed(mini))
                for lo in range(0, len(taken), 8192):
                    t = taken[lo : lo + 8192]
                    key, n, start = part.column(0).to_numpy()[owner[t]], subs[place[t]], first[t] - words.bounds[owner[t]]
                    # Parts of large buckets hold documents, and places in them, at random.
                    lot = mixed(key.view(np.uint64) ^ mixed(start.astype(np.uint64) ^ _SALT)) % np.maximum(n, 1).astype(np.uint64)
                    sub = np.where(n > 1, lot.astype(np.int32), np.int32(-1))
                    ends = words.last[first[t] + count[t] + k - 2]
                    packs = [words.data[x:y] for x, y in zip(words.first[first[t]].tolist(), ends.tolist(), strict=True)]
                    arrays = [pa.array(signed(mini[t])), pa.array(sub.astype(np.int32)), pa.array(key), pa.array(part.column(3).to_numpy()[owner[t]]), pa.array(start.astype(np.int32)), pa.array(packs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["mini", "sub", "doc_key", "row", "start", "words"])

    return wanted.select("doc_key", "text", "minis", "row").mapInArrow(run, "mini bigint, sub int, doc_key bigint, row bigint, start int, words binary")


def _settle(packed: DataFrame, k: int) -> DataFrame:
    """Windows of each bucket, sorted: (open, doc_key, row, first, last, h1, h2).

    open = false: windows first..last of doc_key start in a smaller document.
    open = true: a single window (h1, h2) of a split bucket that is the
    smallest of its sub-bucket.
    """
    schema = "open boolean, doc_key bigint, row bigint, first int, last int, h1 bigint, h2 bigint"
    names = ["open", "doc_key", "row", "first", "last", "h1", "h2"]

    def judge(buckets: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole buckets, in one sort: the bucket is part of the key."""
        mini, sub, doc, row, start = (buckets.column(i).to_numpy() for i in range(5))
        words = Words(buckets.column(5).to_pylist())
        h1, h2 = window_hashes(words, k)
        sizes = np.diff(words.bounds) - k + 1
        pack = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(pack)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[pack]
        with np.errstate(over="ignore"):
            key = h1 ^ mixed(mixed(mini.view(np.uint64)) + sub.astype(np.uint64))[pack]
        order = np.argsort(key)
        new = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (h2[order][1:] != h2[order][:-1])]))
        least = np.empty(len(pack), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[pack][order], new), np.diff(np.append(new, len(pack))))
        again = doc[pack] > least
        at = np.flatnonzero(again)
        if len(at):
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(pack[at]) > 0)]))
            lo, hi = at[cut], at[np.append(cut[1:], len(at)) - 1]
            none = pa.nulls(len(lo), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(lo), bool)), pa.array(doc[pack[lo]]), pa.array(row[pack[lo]]), pa.array(pos[lo].astype(np.int32)), pa.array(pos[hi].astype(np.int32)), none, none], names=names)
        rest = np.flatnonzero(~again & (sub[pack] >= 0))
        if len(rest):
            p = pa.array(pos[rest].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rest), bool)), pa.array(doc[pack[rest]]), pa.array(row[pack[rest]]), p, p, pa.array(signed(h1[rest])), pa.array(signed(h2[rest]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            mini, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = int(np.searchsorted(mini, mini[-1]))
            last += int(np.searchsorted(sub[last:], sub[-1]))  # the last bucket may go on in the next batch
            if held and last == 0 and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) == (mini[0], sub[0]):
                held.append(batch)
                continue
            done = pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
            if done.num_rows:
                yield from judge(done)
        if held:
            yield from judge(pa.Table.from_batches(held))

    dealt = packed.repartition("mini", "sub").sortWithinPartitions("mini", "sub")
    return dealt.select("mini", "sub", "doc_key", "row", "start", "words").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(doc_key, row, first, last): ranges of windows of a document, named by id and hash of its text, that also start in a document with a smaller id."""
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST).cast("bigint")).alias("doc_key"), F.xxhash64("text").alias("row"), "text").where(F.col("text").isNotNull())
    minis = materialize(_minimisers(rows, k, m), "minimisers")
    counted = minis.groupBy("mini").agg(F.count(F.lit(1)).alias("n"), F.min("doc_key").alias("lo"), F.max("doc_key").alias("hi"))
    shared = materialize(counted.where(F.col("lo") < F.col("hi")).select("mini", F.ceil(F.col("n") / BUCKET).cast("int").alias("subs")), "shared")
    # A document needs each of its shared minimisers once.
    of_docs = minis.join(shared, "mini").groupBy("doc_key").agg(F.collect_set(F.struct("mini", "subs")).alias("minis"))
    of_docs = materialize(of_docs, "document_minimisers")
    discard(minis)
    packed = _packed(rows.join(of_docs, "doc_key"), k, m)
    settled = materialize(_settle(packed, k), "settled")
    discard(of_docs)
    closed = settled.where(~F.col("open")).select("doc_key", "row", "first", "last")
    # What split buckets left open: at most one document a sub-bucket for each window.
    still = settled.where(F.col("open"))
    least = still.groupBy("h1", "h2").agg(F.min("doc_key").alias("least"), F.max("doc_key").alias("most")).where(F.col("least") < F.col("most"))
    late = still.join(least, ["h1", "h2"]).where(F.col("doc_key") > F.col("least")).select("doc_key", "row", "first", "last")
    return closed.unionByName(late)


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, keep: tuple[str, ...] = ("doc_id",), texts: bool = True) -> DataFrame:
    """``keep``, n_words, n_removed, kept_sha256 and, with ``texts``, kept: the kept words joined by one space, or the text itself where nothing repeats."""
    with scratch() as stays:
        found = stays(materialize(repeated_windows(docs, k, m).groupBy("doc_key", "row").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "ranges"))
    keyed = docs.select(*keep, F.coalesce("doc_id", F.lit(LAST).cast("bigint")).alias("doc_key"), F.xxhash64("text").alias("row"), F.col("text").alias("_text"))
    joined = keyed.join(found, ["doc_key", "row"], "left").select(*keep, "_text", "ranges")
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in slices(batch, "_text"):
                n_words, n_removed, sums, out = [], [], [], []
                known = part.column(at).is_valid().to_pylist()
                for raw, cuts, valid in zip(raws, part.column(at + 1).to_pylist(), known, strict=True):
                    words = raw.split()
                    n_words.append(len(words))
                    if cuts:
                        change = np.zeros(len(words) + 1, np.int32)
                        for c in cuts:
                            change[c["first"]] += 1
                            change[c["last"] + k] -= 1
                        stay = np.cumsum(change[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    n_removed.append(n_words[-1] - len(words))
                    kept = b" ".join(words)
                    sums.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        out.append((kept if cuts else raw).decode("utf-8", "replace") if valid else None)
                arrays = [*[part.column(i) for i in range(at)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string())]
                if texts:
                    arrays.append(pa.array(out, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])])

    extra = ", kept string" if texts else ""
    return joined.mapInArrow(run, f"{types}, n_words bigint, n_removed bigint, kept_sha256 string{extra}")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(words[i:i + {k} - 1], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {k} + 2)) AS i FROM d)),
m AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win),
c AS (
  SELECT DISTINCT w.doc_id, unnest(range(w.i, w.i + {k})) AS j FROM w JOIN m USING (win) WHERE w.doc_id > m.least),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT d.doc_id, words, coalesce(gone, []) AS gone,
         list_filter(list_transform(range(1, len(words) + 1), lambda j: CASE WHEN list_contains(coalesce(gone, []), j) THEN NULL ELSE words[j] END), lambda x: x IS NOT NULL) AS kept
  FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""
