"""Document fingerprints by SpotSigs.

A spot signature is an anchor, a very common word, with the chain of the next
two content words after it.  Text that is not prose (menus, lists) has few anchors
and so hardly any spot signatures.  The fingerprint of every text is therefore
the set of its spot signatures together with its plain chains, each word with
the next two: it has one kind for short and long texts, so that a small change
of a text is a small change of its fingerprint.  A text without words has one
signature of its characters, and empty text has none.

``with_next`` gives every document the fingerprint of itself, of a following
document and of a text mixed from both.  ``similar_pairs`` is the join: sets are
partitioned by length, each set is filed under the signatures of its prefix in
the length ranges that can reach the threshold, and Jaccard is only worked out
where length and position leave it possible.

Null text counts as empty, null doc_id comes first; rows with equal doc_id are
ordered by their text.  A single document follows itself, and an empty table gives
an empty result.  Columns other than doc_id and text are not read.  Texts of any
length are taken whole; a task holds one of them and its successor.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.text import gram_hashes

CHAIN = 2

#: Common words that serve as anchors.
ANCHORS = frozenset(
    (
        "a an and are as at be but by can do for from had has have he her his i if in is it its not of on or our she so that the their there they this to was we were which will with you "
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous par pas plus pour que qui sa se ses son sont sur un une vous "
        "als am auch auf aus bei das dem den der des die durch ein eine einen einer er es für hat ich im ist mit nach nicht sich sie sind so und von war wie wir zu zum zur "
        "al como con del el ella ellos es esta este la las lo los más muy no para pero por que se si sin su sus una uno y ya"
    ).split()
)
_WORD = re.compile(r"[^\W_]+")


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the spot signatures and plain chains of a text."""
    if not text:
        return np.empty(0, np.uint32)
    words = _WORD.findall(text.lower())
    if not words:
        return np.array([xxhash.xxh32_intdigest(text.encode("utf-8", "replace"))], np.uint32)
    found = _spots(words, chain)
    hashes = np.fromiter(map(xxhash.xxh32_intdigest, found), np.uint32, len(found))
    return np.unique(np.concatenate([hashes, _chains(words, chain)]))


def _chains(words: list[str], chain: int) -> np.ndarray:
    """Hashes of each word with the next ``chain`` words, or with as many as there are."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ends = [gram_hashes(hashes[-k:], k) for k in range(1, min(chain, len(words)) + 1)]
    return (np.concatenate([gram_hashes(hashes, chain + 1), *ends]) >> np.uint64(32)).astype(np.uint32)


def _spots(words: list[str], chain: int, anchors: frozenset[str] = ANCHORS) -> set[str]:
    found = set()
    if chain == 2:  # from the end, with the next two content words at hand
        first = second = ""
        for w in reversed(words):
            if w in anchors:
                if second:
                    found.add(f"{w} {first} {second}")
            else:
                first, second = w, first
        return found
    content = [(i, w) for i, w in enumerate(words) if w not in anchors]
    at = 0
    for i, w in enumerate(words):
        while at < len(content) and content[at][0] <= i:
            at += 1
        if w in anchors and at + chain <= len(content):
            found.add(" ".join([w, *[c for _, c in content[at : at + chain]]]))
    return found


def shown(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; sets whose lengths rule out ``least`` are not compared. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def edit(text: str, other: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``other``."""
    k = len(text) // 4
    return text[: len(text) - k] + other[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt to ranges of doc_id whose bounds are ids in the data;
    the first document of a range also travels to the range before it (the very
    first to the last range), so every document meets its successor in one
    shuffle of the texts.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(2**63)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(lowest).cast("bigint")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    got = rows.agg(F.min("key").alias("first"), F.percentile_approx("key", shares, 20 * ranges).alias("cuts") if shares else F.array().cast("array<bigint>").alias("cuts")).first()
    if got["first"] is None:
        bounds: list[int] = [0]
    else:
        bounds = sorted({got["first"], *(got["cuts"] or [])})
    last = len(bounds) - 1
    marks = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        """Twice the range of a key, and one more where the key opens the range; a search among the bounds."""
        at = np.searchsorted(marks, key.to_numpy(), "right") - 1
        return pd.Series((2 * at + (marks[at] == key.to_numpy())).astype(np.int32))

    # Keys alone go to the search; ranges are then dealt by their number, each to a task of its own.
    placed = rows.withColumn("place", place("key")).withColumn("range", F.shiftright("place", 1))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.when(F.col("range") == 0, F.lit(last)).otherwise(F.col("range") - 1).alias("range"), F.lit(1).alias("guest"))
    opens = F.col("place") % 2 == 1
    dealt = placed.select("doc_id", "key", "text", F.inline(F.when(opens, F.array(own, guest)).otherwise(F.array(own))).alias("to", "guest"))
    sorted_rows = dealt.repartitionById(len(bounds), "to").sortWithinPartitions("to", "guest", "key", "text").select("to", "guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, signatures) of the document whose successor comes next
        out: list[tuple] = []

        def finish(text: str, sigs: np.ndarray, after: str, after_sigs: np.ndarray, doc_id: int | None) -> None:
            changed = edit(text, after)
            changed_sigs = sigs if changed == text else signatures(changed)
            out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), shown(sigs), shown(changed_sigs), jaccard(sigs, changed_sigs), jaccard(sigs, after_sigs)))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        size = 0
        for batch in batches:
            for to, is_guest, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if is_guest and (held is None or held[0] != to):
                    continue  # a later row with the same id as the first guest
                sigs = signatures(text)
                if held is not None and held[0] == to:
                    finish(held[2], held[3], text, sigs, held[1])
                held = None if is_guest else (to, doc_id, text, sigs)
                size += len(text)
                if size > 4 << 20 and out:
                    yield flush()
                    size = 0
        if out:
            yield flush()

    return sorted_rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_sigs, sigs (sorted array of ints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signatures(t or "").astype(np.int64) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([len(s) for s in sigs], pa.int32()), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_sigs", "sigs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_sigs int, sigs array<bigint>")


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, n_class_a, n_class_b, likeness): pairs of classes of equal fingerprints at or above ``threshold``.

    ``a`` and ``b`` are the smallest doc_ids of the classes, null for a class that
    has none; of a pair ``a`` is the one with fewer signatures, or else the smaller id.
    Sets of length n share range floor(log(n) / -log(threshold)) with every set of
    like length; a set is filed in its own range and probes it and the range below.
    """
    prints = fingerprints(docs).where(F.col("n_sigs") > 0)
    # A class has a name of its own: ids may be missing.
    named = prints.withColumn("name", F.sha2(F.concat_ws(",", F.transform("sigs", lambda x: x.cast("string"))), 256))
    classes = named.groupBy("name").agg(F.first("sigs").alias("sigs"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_class"))
    # Rare signatures first, so that the prefix holds the ones that tell most.
    rarity = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    spread = classes.select("name", F.size("sigs").alias("n"), F.explode("sigs").alias("sig")).join(rarity, "sig")
    ordered = spread.groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order"))
    width = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    prefix = ordered.select("name", "n", level.alias("level"), F.posexplode(F.slice("order", F.lit(1), width)).alias("pos", "item")).select("name", "n", "level", "pos", F.col("item.sig").alias("sig"))
    probe = prefix.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "sig", F.explode(F.array("level", F.col("level") - 1)).alias("level"))
    filed = prefix.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), "sig", "level")
    met = filed.join(probe, ["sig", "level"]).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    need = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    possible = met.where((F.col("na") >= F.col("nb") * threshold) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need - F.least("pa", "pb")))
    pairs = possible.select("a", "b").distinct()
    side = lambda x: classes.select(F.col("name").alias(x), F.col("sigs").alias(f"s{x}"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_class").alias(f"d{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    likeness = common / (F.size("sa") + F.size("sb") - common)
    swap = (F.size("sa") == F.size("sb")) & (F.col("da") > F.col("db"))
    low, high = F.when(swap, F.col("db")).otherwise(F.col("da")), F.when(swap, F.col("da")).otherwise(F.col("db"))
    found = joined.select(low.alias("x"), high.alias("y"), likeness.alias("likeness")).where(F.col("likeness") >= threshold)
    return found.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.n_class").alias("n_class_a"), F.col("y.n_class").alias("n_class_b"), "likeness")
