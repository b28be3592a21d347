"""N-gram Jaccard join with set-relation skipping.

Documents are sets of distinct n-word shingles; two link when
100 * intersection >= percent * union.  The answer is each document's class:
the smallest doc_id reachable by links.  Every link between different sets is
accounted for; nothing is capped.

*Equal sets* have equal answers: they are found by a 128-bit digest, and only
one of them takes part in what follows.

*Index lists.*  A linked pair shares a shingle in the prefixes of both sets,
shingles being ordered from rare to common by a frequency sketch (any fixed
order is correct, a good one keeps the lists short).  Prefixes are short: n -
ceil(t n) + 1 shingles.  The list of a shingle is sorted by set size in blocks;
a block is skipped for a probe when its sizes, or the positions of the shingle
in its sets, leave too little room for the overlap that a link needs.

*Answers from similar sets.*  A set verified to be similar to another takes over
that set's answers: both are in one class, so what the one is linked with need
not be computed for the other.  So candidate pairs are tried in two rounds.
First the nearest ``NEIGHBOURS`` by size in every index list are candidates, equal sizes
standing in another order in every list.  Of those that may link each set is
tried with the one that looks nearest and with ``TRIES`` more, chosen by hash: a
large group of near copies is tied together by pairs in proportion to its sets.
Neighbours that are then in different classes are tried as well.  In the second
round all pairs are tried whose sets are still in different classes.

*Bitmaps.*  Before two sets are fetched, the parities of their shingles over 512
positions, and for large sets over several positions a shingle, bound the size
of their difference from below; pairs beyond what a link allows are no links.

Classes are joined by union-find inside tasks, then between tasks, in tables on
the shared folder.

Words are runs of other than ASCII white space, A to Z lower-cased.  With fewer
than ``n`` words the whole sequence is one shingle; null text and text without
words is empty, linked with nothing, and its own class.  Every row is a document
of its own: rows that repeat a doc_id may be in different classes, and a class
takes the smallest of its doc_ids, null only if it has no other.  An empty table
gives an empty result.  Columns other than doc_id and text are not read.  Texts
of any length are taken whole; a task holds the largest of them a few times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweave.llm.store import discard, materialize, scratch, sent
from signalweave.llm.text import Words, gram_hashes, mixed, signed, slices

#: Buckets of the frequency sketch, as a power of two: a table of one byte each travels to the tasks.
SKETCH_BITS = 21
SKETCH_ROWS = 16
#: Words of 64 positions in a set's bitmap.
BITMAP = 8
#: Sets above this size have a second bitmap of four to eight positions a shingle.
WIDE_FROM = 256
#: Sets that follow a set in an index list, by size, and are candidates of the first round.
NEIGHBOURS = 4
#: Partners chosen by hash that each set is tried with in the first round.
TRIES = 2
#: Entries of an index list that are skipped together; lists of up to so many are taken in vector passes with others.
BLOCK = 64
#: Pairs that travel with one copy of a document's set.
FAN = 64
#: Candidate pairs among which a task finds repeated ones.
HELD_PAIRS = 1_000_000
#: Links that a task joins at once.
LOCAL_LINKS = 1_000_000


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one text after the other, and the bounds of each."""
    words = Words(texts, lower=True)
    hashes, held = words.hashes(), np.diff(words.bounds)
    counts = np.maximum(held - n + 1, 0)
    grams = gram_hashes(hashes, n)[words.windows(n)]
    short = np.flatnonzero((held > 0) & (held < n))
    if len(short):
        with np.errstate(over="ignore"):
            whole = [gram_hashes(hashes[words.bounds[i] : words.bounds[i + 1]], int(held[i]))[0] ^ np.uint64(0xA5A5A5A5A5A5A5A5 + int(held[i])) for i in short.tolist()]
        grams = np.insert(grams, np.cumsum(counts)[short], np.array(whole, np.uint64))
        counts[short] = 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        grams[lo:hi].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[bounds[:-1][counts > 0]] = True
    return grams[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def min_overlap(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of this size with any set it links with."""
    return -(-percent * size // 100)


def pair_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def parities(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each of the positions, whether an odd number of a set's shingles falls on it; a row of ``BITMAP`` words for each set."""
    width, sets = 64 * BITMAP, len(bounds) - 1
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    odd = np.bincount(owner * width + (grams & np.uint64(width - 1)).astype(np.int64), minlength=sets * width) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).reshape(sets, BITMAP)


def wide_parities(grams: np.ndarray) -> bytes:
    """The same for one set over four to eight positions a shingle."""
    width = 4 << len(grams).bit_length()
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Lower bound of the difference of two sets by their wide bitmaps; the wider one is folded to the other's width."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_MAP = [f"m{i}" for i in range(BITMAP)]


def named(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the text: the first two find a document again."""
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: (doc_id, row, size, f1, f2, bitmaps) of each document; kind 1: a piece of a task's sketch, as ``wide``."""
    names = ["kind", "doc_id", "row", "size", "f1", "f2", *_MAP, "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        shift = np.uint64(64 - SKETCH_BITS)
        known: set[int] = set()
        for batch in batches:
            for part, raws in slices(batch):
                grams, bounds = shingle_sets(raws, n)
                found = [_digest(grams[lo:hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                fresh = np.zeros(len(raws), bool)
                for i, (f1, _) in enumerate(found):
                    if f1 not in known:  # equal sets count once a task
                        if len(known) >= 500_000:
                            known.clear()
                        known.add(f1)
                        fresh[i] = True
                sizes = np.diff(bounds)
                sketch += np.bincount((grams[np.repeat(fresh, sizes)] >> shift).astype(np.int64), minlength=len(sketch))
                m = len(raws)
                maps = parities(grams, bounds)
                arrays = [pa.array(np.zeros(m, np.int32)), part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array([f for f, _ in found], pa.int64()), pa.array([f for _, f in found], pa.int64())]
                wide = [wide_parities(grams[lo:hi]) if hi - lo > WIDE_FROM else None for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(maps[:, i]) for i in range(BITMAP)], pa.array(wide, pa.binary())], names=names)
        if sketch.any():
            pieces = [p.tobytes() for p in np.split(sketch, SKETCH_ROWS)]
            none = pa.nulls(SKETCH_ROWS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SKETCH_ROWS, np.int32)), pa.array(range(SKETCH_ROWS), pa.int64()), *[none] * (4 + BITMAP), pa.array(pieces, pa.binary())], names=names)

    maps = ", ".join(f"{m} bigint" for m in _MAP)
    return named(docs).mapInArrow(run, f"kind int, doc_id bigint, row bigint, size bigint, f1 bigint, f2 bigint, {maps}, wide binary")


def _frequency_classes(pieces: DataFrame) -> np.ndarray:
    """log2 of the sketch's counts, one byte a bucket; its size does not depend on the input."""
    # Tasks' pieces are summed in two steps, so that no task holds those of all tasks.
    schema = "piece bigint, lane int, counts binary"

    def total(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << SKETCH_BITS) // SKETCH_ROWS, np.int64)
        for raw in part["counts"]:
            out += np.frombuffer(raw, np.int64 if len(raw) == out.nbytes else np.int32)
        return pd.DataFrame({"piece": [part["piece"].iloc[0]], "lane": [0], "counts": [out.tobytes()]})

    def levels(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.frombuffer(total(part)["counts"].iloc[0], np.int64)
        return pd.DataFrame({"piece": [part["piece"].iloc[0]], "lane": [0], "counts": [np.floor(2 * np.log2(counts + 1)).astype(np.uint8).tobytes()]})

    lanes = pieces.select(F.col("doc_id").alias("piece"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("lane"), F.col("wide").alias("counts"))
    once = lanes.groupBy("piece", "lane").applyInPandas(total, schema)
    got = {row["piece"]: row["counts"] for row in once.groupBy("piece").applyInPandas(levels, schema).collect()}
    width = (1 << SKETCH_BITS) // SKETCH_ROWS
    return np.concatenate([np.frombuffer(got.get(i, bytes(width)), np.uint8) for i in range(SKETCH_ROWS)])


def _prefixes(docs: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(token, f1, size, pos): the rarest shingles of each set; an equal set counts once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rank, shift = shared.value, np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            for _, raws in slices(batch):
                grams, bounds = shingle_sets(raws, n)
                ranks = rank[(grams >> shift).astype(np.int64)]
                tokens, owners, sizes, places = [], [], [], []
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if lo == hi:
                        continue
                    f1 = _digest(grams[lo:hi])[0]
                    if f1 in seen:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(f1)
                    take = hi - lo - min_overlap(hi - lo, percent) + 1
                    tokens.append(grams[lo + np.argsort(ranks[lo:hi], kind="stable")[:take]])
                    owners.append(f1)
                    sizes.append(hi - lo)
                    places.append(take)
                if tokens:
                    takes = np.array(places)
                    ends = np.cumsum(takes)
                    pos = np.arange(ends[-1]) - np.repeat(ends - takes, takes)
                    arrays = [pa.array(signed(np.concatenate(tokens))), pa.array(np.repeat(np.array(owners, np.int64), takes)), pa.array(np.repeat(np.array(sizes, np.int32), takes)), pa.array(pos.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["token", "f1", "size", "pos"])

    return docs.select("text").mapInArrow(run, "token bigint, f1 bigint, size int, pos int")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first one, cut where it changes; a long list is put together once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        token = cols[0]
        if held and token[0] == token[-1] == held[0][0][0]:
            held.append(cols)
            continue
        last = int(np.searchsorted(token, token[-1]))  # the last list may go on in the next batch
        held.append([c[:last] for c in cols])
        done = [np.concatenate(parts) for parts in zip(*held, strict=True)]
        if len(done[0]):
            yield done
        held = [[c[last:] for c in cols]]
    if held:
        yield [np.concatenate(parts) for parts in zip(*held, strict=True)]


def may_link(size_a: np.ndarray, pos_a: np.ndarray, size_b: np.ndarray, pos_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that share a shingle at these positions can link: by their sizes, and by what is left after the positions."""
    a, b = size_a.astype(np.int64), size_b.astype(np.int64)
    room = 1 + np.minimum(a - pos_a - 1, b - pos_b - 1) + np.minimum(pos_a, pos_b)
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (room >= pair_overlap(a, b, percent))


def shared_first(size_a: np.ndarray, pos_a: np.ndarray, size_b: np.ndarray, pos_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets can link whose first common shingle has these positions: all that they share stands there or later."""
    a, b = size_a.astype(np.int64), size_b.astype(np.int64)
    return np.minimum(a - pos_a, b - pos_b) >= pair_overlap(a, b, percent)


def _lists(prefixes: DataFrame, percent: int) -> DataFrame:
    """kind 0: the index lists with two or more sets (token, f1, size, pos); kind 1: pairs (token, f1) of near neighbours in a list."""
    names = ["kind", "token", "f1", "size", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_lists(batches):
            same = cols[0][1:] == cols[0][:-1]
            more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if not more.any():
                continue
            token, f1, size, pos = (c[more] for c in cols)
            # Equal sizes stand in another order in every list, so that neighbours differ from list to list.
            with np.errstate(over="ignore"):
                shuffled = mixed((f1 ^ token).view(np.uint64))
            order = np.lexsort((shuffled, size, token))
            token, f1, size, pos = token[order], f1[order], size[order], pos[order]
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (f1[1:] != f1[:-1])])  # tasks repeat equal sets
            token, f1, size, pos = token[fresh], f1[fresh], size[fresh], pos[fresh]
            same = token[1:] == token[:-1]
            more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            if not more.any():
                continue
            arrays = [pa.array(np.zeros(int(more.sum()), np.int32)), *[pa.array(c[more]) for c in (token, f1, size, pos)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            close = []
            for step in range(1, NEIGHBOURS + 1):
                at = np.flatnonzero(token[step:] == token[:-step])
                at = at[may_link(size[at], pos[at], size[at + step], pos[at + step], percent)]
                close.append(pd.DataFrame({"token": np.minimum(f1[at], f1[at + step]), "f1": np.maximum(f1[at], f1[at + step])}))
            pairs = pd.concat(close).drop_duplicates()
            if len(pairs):
                none = pa.nulls(len(pairs), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(pairs), np.int32)), pa.array(pairs["token"].to_numpy()), pa.array(pairs["f1"].to_numpy()), none, none], names=names)

    return prefixes.repartition("token").sortWithinPartitions("token").mapInArrow(run, "kind int, token bigint, f1 bigint, size int, pos int")


def list_pairs(size: np.ndarray, pos: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one list, sorted by size, whose sets may link and have different labels.

    Blocks of the list are skipped by size, by the least position in them and by labels.
    """
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    n = len(size)
    starts = np.arange(0, n, BLOCK)
    floor = np.minimum.reduceat(pos, starts)
    least, greatest = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
    for i in range(1, n):
        low = int(np.searchsorted(size[:i], min_overlap(int(size[i]), percent)))
        for b in range((i - 1) // BLOCK, low // BLOCK - 1, -1):
            lo, hi = max(low, b * BLOCK), min(i, (b + 1) * BLOCK)
            if lo >= hi or least[b] == greatest[b] == label[i]:
                continue
            need_least = pair_overlap(int(size[lo]), int(size[i]), percent)
            if 1 + min(int(size[hi - 1]) - int(floor[b]) - 1, int(size[i]) - int(pos[i]) - 1) + min(int(pos[lo:hi].max()), int(pos[i])) < need_least:
                continue
            ok = (label[lo:hi] != label[i]) & may_link(size[lo:hi], pos[lo:hi], size[i : i + 1], pos[i : i + 1], percent)
            found = np.flatnonzero(ok) + lo
            left.append(found)
            right.append(np.full(len(found), i))
    return np.concatenate(left), np.concatenate(right)


def _cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidate pairs of sets in different classes; ``lists`` has columns label and a bitmap of half the width, h0 and on.

    A pair that links is found in the list of its first common shingle, so each list gives
    only the pairs that could link if its shingle were their first.
    """
    half = [f"h{i}" for i in range(BITMAP // 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for cols in _whole_lists(batches):
            token = cols[0]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            of = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
            # Lists of one class have nothing to try.
            label = cols[4]
            several = (np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts))[of]
            if not several.any():
                continue
            token, f1, size, pos, label, *maps = (c[several] for c in cols)
            order = np.lexsort((f1, size, token))
            token, f1, size, pos, label = token[order], f1[order], size[order], pos[order], label[order]
            bits = np.stack(maps, axis=1)[order].view(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            lengths = np.diff(cuts)
            longer = lengths > BLOCK
            for lo, hi in zip(cuts[:-1][longer].tolist(), cuts[1:][longer].tolist(), strict=True):
                i, j = list_pairs(size[lo:hi], pos[lo:hi], label[lo:hi], percent)
                yield from add(held, i + lo, j + lo, f1, size, pos, bits)
            small = np.flatnonzero(np.repeat(~longer, lengths))
            for step in range(1, int(lengths[~longer].max(initial=1))):
                i = small[:-step][small[step:] - small[:-step] == step]
                i = i[(token[i] == token[i + step]) & (label[i] != label[i + step])]
                j = i + step
                ok = may_link(size[i], pos[i], size[j], pos[j], percent)
                yield from add(held, i[ok], j[ok], f1, size, pos, bits)

        if held:
            yield told(pd.concat(held).drop_duplicates())

    def told(rows: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows["a"].to_numpy()), pa.array(rows["b"].to_numpy())], names=["a", "b"])

    def add(held: list[pd.DataFrame], i: np.ndarray, j: np.ndarray, f1: np.ndarray, size: np.ndarray, pos: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            ok = shared_first(size[x], pos[x], size[y], pos[y], percent)
            x, y = x[ok], y[ok]
            total = size[x].astype(np.int64) + size[y]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            ok = apart <= total - 2 * pair_overlap(total, 0, percent)
            a, b = f1[x[ok]], f1[y[ok]]
            if not len(a):
                continue
            held.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates())
            if sum(map(len, held)) > HELD_PAIRS:
                # Pairs are told before the end only where there are many different ones.
                rows = pd.concat(held).drop_duplicates()
                held[:] = [rows]
                if 2 * len(rows) > HELD_PAIRS:
                    held.clear()
                    yield told(rows)

    dealt = lists.repartition("token").sortWithinPartitions("token")
    return dealt.select("token", "f1", "size", "pos", "label", *half).mapInArrow(run, "a bigint, b bigint").distinct()


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) with doc_id and row of both and ``apart``, the share by which their bitmaps differ, without pairs that this rules out."""
    # A set is in many pairs: each side is reduced to its sets before the two meet.
    ends = pairs.select(F.col("a").alias("f1")).distinct().unionByName(pairs.select(F.col("b").alias("f1")).distinct()).distinct()
    side = materialize(sets.join(ends, "f1", "left_semi").select("f1", "doc_id", "row", "size", *_MAP, "wide"), "ends")
    of = [side.select([F.col(c).alias(f"{c}_{x}") for c in side.columns]) for x in "ab"]
    joined = pairs.join(of[0], F.col("a") == F.col("f1_a")).join(of[1], F.col("b") == F.col("f1_b"))
    apart: Column = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in _MAP), F.lit(0))
    total = F.col("size_a") + F.col("size_b")
    room = total - 2 * F.floor((total * percent + (99 + percent)) / (100 + percent))
    kept = joined.where(apart <= room).select("a", "b", "doc_id_a", "row_a", "doc_id_b", "row_b", room.alias("room"), total.alias("total"), apart.cast("bigint").alias("apart"), "wide_a", "wide_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            room, total, apart = (batch.column(i).to_numpy() for i in (6, 7, 8))
            maps = zip(batch.column(9).to_pylist(), batch.column(10).to_pylist(), strict=True)
            wide = np.array([least_difference(x, y) if x and y else 0 for x, y in maps], np.int64)
            apart = np.maximum(apart, wide)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(apart / total)], names=[*batch.schema.names[:6], "apart"]).filter(pa.array(apart <= room))

    return kept.mapInArrow(run, "a bigint, b bigint, doc_id_a bigint, row_a bigint, doc_id_b bigint, row_b bigint, apart double")


def _few(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each set the nearest one and ``TRIES`` of least hash; a pair stays if one of its sets takes it."""
    pair = F.struct(F.xxhash64("a", "b").alias("lot"), *pairs.columns)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("f1"), pair.alias("pair"))
    # Least hashes under several orders: an aggregate with a partial step, whatever the size of the group.
    orders = [F.min_by("pair", F.struct("pair.apart", "pair.lot")), *[F.min_by("pair", F.xxhash64("pair.lot", F.lit(i))) for i in range(TRIES)]]
    taken = ends.groupBy("f1").agg(F.array(*orders).alias("taken")).select(F.inline("taken"))
    return taken.select(*pairs.columns).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets."""
    ends = pairs.select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(FAN)).alias("fan"), F.inline(F.array(*[F.struct(F.col(f"doc_id_{x}").alias("w_doc"), F.col(f"row_{x}").alias("w_row"), F.col(x).alias("f1")) for x in "ab"])))
    wanted = materialize(ends.groupBy("w_doc", "w_row", "f1", "fan").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "wanted")
    keys = sent(wanted.select(F.col("w_doc").alias("k_doc"), F.col("w_row").alias("k_row")).distinct())
    found = named(docs).join(keys, F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("row") == F.col("k_row")), "left_semi")
    fetched = found.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("row") == F.col("w_row"))).select("f1", "fan", "text", "pairs")
    names = ["a", "b", "shingles"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for part, raws in slices(batch):
                grams, bounds = shingle_sets(raws, n)
                a, b, held, size = [], [], [], 0
                for i, (f1, fan, ps) in enumerate(zip(*[part.column(c).to_pylist() for c in (0, 1, 3)], strict=True)):
                    if (f1, fan) in sent:  # another row without an id and of the same text
                        continue
                    sent.add((f1, fan))
                    packed = grams[bounds[i] : bounds[i + 1]].tobytes()
                    for p in ps:
                        a.append(p["a"])
                        b.append(p["b"])
                        held.append(packed)
                        size += len(packed)
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(held, pa.binary())], names=names)
                            a, b, held, size = [], [], [], 0
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(held, pa.binary())], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, done = None, b"", False
        for batch in batches:
            a, b = [], []
            for x, y, raw in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (x, y) != now:
                    now, first, done = (x, y), raw, False
                elif raw != first and not done:
                    s, t = np.frombuffer(first, np.uint64), np.frombuffer(raw, np.uint64)
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    done = True
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        a.append(x)
                        b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sets = fetched.mapInArrow(fetch, "a bigint, b bigint, shingles binary")
    links = materialize(sets.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(compare, "a bigint, b bigint"), "links")
    discard(wanted)
    return links


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) by the links that a task sees: union-find, ``LOCAL_LINKS`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        def told() -> pa.RecordBatch:
            nodes = list(up)
            out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])
            up.clear()
            return out

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > LOCAL_LINKS:
                yield told()
        if up:
            yield told()

    return links.mapInArrow(run, "node bigint, root bigint")


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b): label is the smallest node reachable.

    Each round finds the roots of nodes task by task.  A node with several roots
    takes the least, and its other roots are linked with that one: these links
    go to the next round.  The rounds end when no node has two roots.
    """
    levels, left = [], links
    while True:
        roots = _roots(left).groupBy("node").agg(F.min("root").alias("least"), F.collect_set("root").alias("roots"))
        found = materialize(roots, "roots")
        levels.append(found.select("node", "least"))
        many = found.where(F.size("roots") > 1)
        left = many.select(F.explode("roots").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
        if many.isEmpty():
            break
        left = left.repartition("b")
    out = levels.pop()
    while levels:
        below = levels.pop()
        out = below.join(out.select(F.col("node").alias("least"), F.col("least").alias("last")), "least", "left").select("node", F.coalesce("last", "least").alias("least"))
    return materialize(out.withColumnRenamed("least", "label"), "labels")


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; with ``keys`` also row, the hash of its text, and class_key, which names its class (null for empty sets)."""
    with scratch() as keep:
        scanned = keep(materialize(_sets(docs, n), "sets"))
        rows = scanned.where(F.col("kind") == 0)
        classes = _frequency_classes(scanned.where(F.col("kind") == 1))
        # One representative of equal sets, found again by doc_id and hash of its text; the second half of the digest guards the first.
        first = F.min_by(F.struct("doc_id", "row"), F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("one")
        equal = rows.where(F.col("size") > 0).groupBy("f1", "f2").agg(first, *[F.first(c).alias(c) for c in ("size", *_MAP, "wide")])
        sets = materialize(equal.select("f1", "f2", "one.doc_id", "one.row", "size", *_MAP, "wide"), "equal_sets")
        listed = materialize(_lists(_prefixes(docs, n, percent, classes), percent), "lists")

        # First neighbours in the lists, then every pair whose sets are still apart.
        near = materialize(listed.where(F.col("kind") == 1).select(F.col("token").alias("a"), F.col("f1").alias("b")).distinct(), "near")
        plausible = materialize(_plausible(near, sets, percent), "plausible")
        few = materialize(_few(plausible), "few")
        labels = connected(_verified(few, docs, n, percent))
        # Neighbours that have not been tried and are still in different classes come next, so that fewer sets are left for the second round.
        ends = plausible.join(few.select("a", "b"), ["a", "b"], "left_anti")
        for x in "ab":
            ends = ends.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), x, "left")
        apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
        late = _verified(materialize(ends.where(apart).select(*plausible.columns), "apart"), docs, n, percent)
        if not late.isEmpty():
            labels = connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(late))
        half = [F.col(_MAP[i]).bitwiseXOR(F.col(_MAP[i + BITMAP // 2])).alias(f"h{i}") for i in range(BITMAP // 2)]
        of_sets = sets.join(labels.withColumnRenamed("node", "f1"), "f1", "left").select("f1", F.coalesce("label", "f1").alias("label"), *half)
        pairs = materialize(_cross_pairs(listed.where(F.col("kind") == 0).drop("kind").join(of_sets, "f1"), percent), "pairs")
        more = _verified(_plausible(pairs, sets, percent), docs, n, percent)
        for table in (listed, near, plausible, few, pairs):
            discard(table)
        # Where the second round found links, the classes take in both rounds' links.
        final = labels if more.isEmpty() else connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

        labelled = sets.join(final.withColumnRenamed("node", "f1"), "f1", "left").select("f1", "f2", "doc_id", F.coalesce("label", "f1").alias("class_key"))
        ids = labelled.groupBy("class_key").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets")
        of_class = keep(materialize(labelled.join(ids, "class_key", "left").select("f1", "f2", "class_key", F.coalesce("component_id", "doc_id").alias("component_id")), "classes"))
    out = rows.join(of_class, ["f1", "f2"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *(["row", "class_key"] if keys else []))


def jaccard_links(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """All links, not only what ties classes together: (links, members).

    links: a, b, each pair of different sets that link, once, by the names of the
    sets; members: doc_id, row, n_shingles, name, n_copies (rows with that set),
    n_links (rows that this one links with: the copies of its own set and those of
    the sets that it links with).  Rows without words have no name and no link.

    Candidates are all pairs of the index lists whose blocks are not skipped, so
    the work grows with the links, and with the square of a group in which all
    texts are near to each other; classes alone are had for less.
    """
    with scratch() as keep:
        scanned = keep(materialize(_sets(docs, n), "sets"))
        rows = scanned.where(F.col("kind") == 0)
        classes = _frequency_classes(scanned.where(F.col("kind") == 1))
        first = F.min_by(F.struct("doc_id", "row"), F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("one")
        equal = rows.where(F.col("size") > 0).groupBy("f1", "f2").agg(first, F.count(F.lit(1)).alias("n_copies"), *[F.first(c).alias(c) for c in ("size", *_MAP, "wide")])
        sets = keep(materialize(equal.select("f1", "f2", "one.doc_id", "one.row", "n_copies", "size", *_MAP, "wide"), "equal_sets"))
        half = [F.col(_MAP[i]).bitwiseXOR(F.col(_MAP[i + BITMAP // 2])).alias(f"h{i}") for i in range(BITMAP // 2)]
        # Every set is a class of its own, so every pair of a list is one between classes.
        apart = sets.select("f1", F.col("f1").alias("label"), *half)
        listed = _lists(_prefixes(docs, n, percent, classes), percent).where(F.col("kind") == 0).drop("kind")
        pairs = materialize(_cross_pairs(listed.join(apart, "f1"), percent), "pairs")
        links = keep(_verified(_plausible(pairs, sets, percent), docs, n, percent))
    copies = sets.select("f1", "n_copies")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(copies, F.col("b") == F.col("f1")).groupBy("a").agg(F.sum("n_copies").alias("others"))
    of_sets = sets.select("f1", "f2", "n_copies").join(linked.withColumnRenamed("a", "f1"), "f1", "left").withColumn("n_links", F.col("n_copies") - 1 + F.coalesce("others", F.lit(0)))
    members = rows.join(of_sets, ["f1", "f2"], "left")
    name = F.when(F.col("size") > 0, F.col("f1")).alias("name")
    return links.select("a", "b"), members.select("doc_id", "row", F.col("size").alias("n_shingles"), name, F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < {n} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {n} + 2), lambda i: array_to_string(words[i:i + {n} - 1], ' ')) END) AS shingle
  FROM w),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b
  WHERE 100 * common >= {percent} * (x.size + y.size - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(z.size, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN z USING (doc_id)
JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
