"""Operators on texts, files and pages: shapes, scripts, links, refusals, clones."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweave.functions.expressions import hamming
from signalweave.operators.graph import components
from signalweave.storage import cut, discard, written

# ---- shapes ----------------------------------------------------------------


def text_shape(docs: DataFrame, heading: str = "#", k: int = 20) -> DataFrame:
    """(id, lines, words, headings): counts and the first k heading lines."""
    lines = F.split("text", "\n")
    heads = F.slice(F.filter(lines, lambda x: x.startswith(heading)), 1, k)
    return docs.select("id", F.size(lines).cast("bigint").alias("lines"), F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("words"), heads.alias("headings"))


def delimited_shape(docs: DataFrame, delimiters: str = ",;\t") -> DataFrame:
    """(id, delimiter, columns, rows): the delimiter that the first line has most of, its columns, and the lines below."""
    first = F.substring_index("text", "\n", 1)
    count = lambda c: F.char_length(first) - F.char_length(F.replace(first, F.lit(c), F.lit("")))
    options = F.array(*[F.struct(count(c).alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("c")) for i, c in enumerate(delimiters)])
    best = F.array_max(options)
    filled = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    split = F.transform(F.split(first, F.concat(F.lit(r"\Q"), best["c"], F.lit(r"\E"))), F.trim)
    return docs.select("id", F.when(best["n"] > 0, best["c"]).alias("delimiter"), F.when(best["n"] > 0, split).otherwise(F.array(F.trim(first))).alias("columns"), F.greatest(filled - 1, F.lit(0)).cast("bigint").alias("rows"))


def script_shares(docs: DataFrame) -> DataFrame:
    """(id, latin, cyrillic, language): letters by script; Cyrillic from 15 percent on decides for ru."""
    latin, cyrillic = F.regexp_count("text", F.lit("[A-Za-z]")), F.regexp_count("text", F.lit("[а-яА-ЯёЁ]"))
    share = F.try_divide(cyrillic, latin + cyrillic)
    return docs.select("id", latin.cast("bigint").alias("latin"), cyrillic.cast("bigint").alias("cyrillic"), F.when(share >= 0.15, "ru").when(share.isNotNull(), "en").alias("language"))


def mixed_script_words(docs: DataFrame) -> DataFrame:
    """(id, words): distinct words with Latin and Cyrillic letters, outside code, addresses and paths."""
    plain = F.regexp_replace("text", r"`[^`]*`|https?://\S+|\S*/\S*", " ")
    words = F.regexp_extract_all(plain, F.lit(r"[A-Za-zа-яА-ЯёЁ]+"), 0)
    both = F.filter(words, lambda w: w.rlike("[A-Za-z]") & w.rlike("[а-яА-ЯёЁ]"))
    return docs.select("id", F.array_sort(F.array_distinct(both)).alias("words")).where(F.size("words") > 0)


# ---- links -----------------------------------------------------------------


#: A link of an HTML page: its target in double quotes, in single quotes or bare, and what it encloses.
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, anchor, target): links of HTML pages, anchors lower-cased with single spaces; links within the page and empty ones are left out."""
    groups = [F.regexp_extract_all("html", F.lit(LINK), i) for i in range(1, 5)]
    found = F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)])
    links = pages.select("page_id", F.inline(found)).toDF("page_id", "double", "single", "bare", "anchor")
    anchor = F.trim(F.regexp_replace(F.lower(F.regexp_replace("anchor", "<[^>]*>", "")), r"\s+", " "))
    target = F.trim(F.concat(*[F.coalesce(c, F.lit("")) for c in ("double", "single", "bare")]))
    return links.select("page_id", anchor.alias("anchor"), target.alias("target")).where((F.col("target") != "") & ~F.col("target").startswith("#"))


def ambiguous_anchors(links: DataFrame) -> DataFrame:
    """(anchor, targets): anchors that lead to two targets or more."""
    named = links.where(F.col("anchor") != "")
    return named.groupBy("anchor").agg(F.count_distinct("target").alias("targets")).where(F.col("targets") >= 2)


def link_checks(links: DataFrame) -> DataFrame:
    """(page_id, links, empty_anchors, split_anchors): split: one anchor, several targets on the page."""
    split = links.where(F.col("anchor") != "").groupBy("page_id", "anchor").agg(F.count_distinct("target").alias("_t")).where(F.col("_t") >= 2).groupBy("page_id").agg(F.count(F.lit(1)).alias("split_anchors"))
    sums = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("anchor") == "").alias("empty_anchors"))
    return sums.join(split, "page_id", "left").select("page_id", "links", "empty_anchors", F.coalesce("split_anchors", F.lit(0)).cast("bigint").alias("split_anchors"))


def content_graph(links: DataFrame, site: Column) -> DataFrame:
    """Distinct (repo, src, dst) edges from pages to the targets they name."""
    return links.select(site.alias("repo"), F.col("page").alias("src"), F.col("target").alias("dst")).where(F.col("src") != F.col("dst")).distinct()


# ---- refusals --------------------------------------------------------------

#: Openings with which an assistant declines.
REFUSAL = r"(?i)\b(i can(?:no|')t|i am unable|i'm unable|i won't|cannot help|can't help|not able to)\b"


def detect_refusals(turns: DataFrame, pattern: str = REFUSAL, longest: int = 600) -> DataFrame:
    """(conv_id, turn, refused): short assistant replies with a declining phrase; an empty reply is none."""
    said = F.col("role") == "assistant"
    hit = (F.char_length("text") > 0) & (F.char_length("text") <= longest) & F.col("text").rlike(pattern)
    return turns.where(said).select("conv_id", "turn", F.coalesce(hit, F.lit(False)).alias("refused"))


# ---- clones ----------------------------------------------------------------


def line_blocks(docs: DataFrame, size: int) -> DataFrame:
    """(id, block, body): runs of ``size`` lines that are not blank, with numbers and strings masked.

    A run starts at every line, so a passage gives the same runs wherever it stands in a text.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    masked = F.transform(lines, lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(x, r'"[^"\n]*"', "S"), r"\d+", "N")))
    starts = F.sequence(F.lit(1), F.size("masked") - size + 1)
    kept = docs.select("id", masked.alias("masked")).where(F.size("masked") >= size)
    return kept.select("id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("masked", i, size), "\n"))).alias("block", "body"))


def exact_clones(blocks: DataFrame, min_chars: int = 80) -> DataFrame:
    """(hash, n, docs): bodies that occur twice or more."""
    long = blocks.where(F.char_length("body") >= min_chars).select("id", F.sha1("body").alias("hash"))
    return long.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("docs")).where(F.col("n") >= 2)


#: Tokens whose bits a task remembers.
KNOWN_TOKENS = 200_000


def _votes(texts: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(id, n, c0 to c31): of a text's tokens the number, and how many have each bit set, bit i + 32 in the upper half of ci."""
    names = ["id", "n", *[f"c{i}" for i in range(32)]]

    token = re.compile(f"[a-zа-яё0-9]{{{max(shortest, 1)},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        bits = np.zeros((1024, 64))

        def at(word: str) -> int:
            nonlocal bits
            i = place.setdefault(word, len(place))
            if i == len(bits):
                bits = np.concatenate([bits, np.zeros_like(bits)])
            if i == len(place) - 1:
                h = hashlib.sha1(word.encode()).digest()[:8]
                bits[i] = np.unpackbits(np.frombuffer(h[::-1], np.uint8), bitorder="little")
            return i

        for batch in batches:
            counts = np.zeros((batch.num_rows, 64), np.int64)
            n = np.zeros(batch.num_rows, np.int64)
            for row, text in enumerate(batch.column(1)):
                held = Counter([t[:longest] for t in token.findall(text.as_py() or "")])
                if not held:
                    continue
                if len(place) > KNOWN_TOKENS:
                    place.clear()
                of, times = [at(t) for t in held], np.fromiter(held.values(), np.float64, len(held))
                counts[row] = (times @ bits[of]).astype(np.int64)
                n[row] = times.sum()
            packed = counts[:, :32] | counts[:, 32:] << 32
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *[pa.array(packed[:, i]) for i in range(32)]], names=names)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, ", ".join([f"id {kind}", *[f"{c} bigint" for c in names[1:]]]))


def simhash64(docs: DataFrame, shortest: int = 3, longest: int = 5) -> DataFrame:
    """(id, hash): each token of ``shortest`` characters or more, cut to ``longest``, votes on 64 bits by its SHA-1.

    Bits are counted where the text is, each distinct token of it hashed once, two
    counts in a number; rows that repeat an id are one text.
    Texts of up to 2^31 tokens.  A text without such a token, or null, has hash 0.
    İ, the one letter whose lower case Java makes two characters that part a token, is i.
    """
    one = F.lit(1).cast("bigint")
    counted = _votes(docs.select("id", F.lower(F.translate("text", "İ", "i")).alias("text")), shortest, longest)
    counted = counted.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(32)])
    total = F.lit(0).cast("bigint")
    for i in range(32):
        for count, bit in ((F.col(f"c{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i), (F.shiftrightunsigned(f"c{i}", 32), i + 32)):
            total = total.bitwiseOR(F.when(2 * count > F.col("n"), F.shiftleft(one, bit)).otherwise(F.lit(0).cast("bigint")))
    return counted.select("id", total.alias("hash"))


def _masks(most: int, blocks: int) -> list[int]:
    """The bits of each key made of ``blocks - most`` of ``blocks`` blocks, as signed numbers."""
    if not 0 <= most < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed, and 64 at most")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - most)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def near_hashes(hashes: DataFrame, most: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b, distance): all pairs of different hashes that differ in at most ``most`` bits.

    The bits are cut into ``blocks`` blocks.  Two such hashes agree in
    ``blocks - most`` of them at least, so they share a key made of so many
    blocks and none is lost.  More blocks make longer keys, hence smaller
    groups, and more keys a hash: 6 blocks give 15 keys of about 21 bits, 8 give
    70 of 32.  Unless ``blocks`` is given there are as many as make a key longer
    than the table's size needs, so that a key's group stays small at any size.
    Equal hashes are one row first, so a group of copies costs one comparison;
    pairs are between the smallest ids of different hashes.
    """
    unique = cut(hashes.groupBy("hash").agg(F.min("id").alias("id")))
    if blocks is None:
        need = unique.count().bit_length()
        blocks = next((b for b in range(most + 2, 65) if 64 * (b - most) // b > need), 64)
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("hash").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for i, m in enumerate(_masks(most, blocks))])
    banded = unique.select("id", "hash", F.inline(keys))
    a, b = banded.select("band", "key", F.col("id").alias("a"), F.col("hash").alias("ha")), banded.select("band", "key", F.col("id").alias("b"), F.col("hash").alias("hb"))
    pairs = a.join(b, ["band", "key"]).where(F.col("a") < F.col("b")).withColumn("distance", hamming(F.col("ha"), F.col("hb")))
    return pairs.where(F.col("distance") <= most).select("a", "b", "distance").distinct()


#: Pairs of a component up to which one task scans it.
SCANNED = 200_000


def greedy_dedupe(rows: DataFrame, pairs: DataFrame, scanned: int = SCANNED) -> DataFrame:
    """(id, kept): in id order, a row goes when an earlier kept row is its pair.

    Rows that no pair leads to do not matter to each other, so each connected
    component is scanned by itself, many in a task.  A component of more than
    ``scanned`` pairs is settled in rounds over all tasks instead: a row is kept
    once no earlier unsettled pair remains, and goes once an earlier one is kept.
    Each round settles a row at least, and they go on until all are.  Ids are
    whole numbers; pairs of a row with itself or with a row that is not among
    ``rows`` do not count.
    """
    ids = rows.select(F.col("id").cast("bigint").alias("id")).distinct()
    both = pairs.select(F.least("a", "b").cast("bigint").alias("early"), F.greatest("a", "b").cast("bigint").alias("late")).where("early < late").distinct()
    both = both.join(ids.select(F.col("id").alias("early")), "early", "left_semi").join(ids.select(F.col("id").alias("late")), "late", "left_semi")
    both = cut(both)
    parts = components(both.select(F.col("early").alias("a"), F.col("late").alias("b")))
    placed = cut(both.join(parts.select(F.col("node").alias("late"), "component"), "late"))
    large = placed.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > scanned).select("component")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, beaten, now = None, {}, False, None

        def settle() -> None:
            if now is not None:
                kept[now] = not beaten

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.bool_())], names=["id", "kept"])

        for batch in batches:
            for component, late, early in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if component != at:
                    settle()
                    if kept:
                        yield told()
                    at, kept, beaten, now = component, {}, False, None
                if late != now:
                    settle()
                    now, beaten = late, False
                beaten = beaten or kept.setdefault(early, True)  # earlier than all its pairs: kept
        settle()
        if kept:
            yield told()

    # Were both sides dealt by component, Spark would leave out the repartition as done, and then deal the rows otherwise as it reads them.
    small = placed.join(F.broadcast(large), "component", "left_anti").select("component", "late", "early").repartition("component").sortWithinPartitions("component", "late", "early")
    settled = small.mapInArrow(scan, "id bigint, kept boolean")
    rest = cut(placed.join(large, "component", "left_semi").select("early", "late"))
    if not rest.isEmpty():
        settled = settled.unionByName(_settled_in_rounds(rest))
    return ids.join(settled, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def _settled_in_rounds(pairs: DataFrame) -> DataFrame:
    """(id, kept) for the rows of ``pairs`` (early, late)."""
    state = cut(pairs.select(F.explode(F.array("early", "late")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        early = pairs.join(state.select(F.col("id").alias("early"), F.col("kept").alias("_k")), "early")
        seen = early.groupBy(F.col("late").alias("id")).agg(F.bool_or(F.coalesce("_k", F.lit(False))).alias("_beaten"), F.bool_or(F.col("_k").isNull()).alias("_open"))
        joined = state.join(seen, "id", "left")
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("_beaten", F.lit(False)), F.lit(False)).when(~F.coalesce("_open", F.lit(False)), F.lit(True))
        state = cut(joined.select("id", new.alias("kept")))
        if state.where(F.col("kept").isNull()).isEmpty():
            return state


#: Rows with one key up to which one task compares them.
CROWD = 50_000
#: Rows that one key may have on average, as a power of 2, when hashes are even.
TOGETHER = 8
#: Rows with one key that are compared along with those of other keys.
SMALL_GROUP = 32


def _beaten_in_group(hashes: np.ndarray, source: np.ndarray, target: np.ndarray, most: int) -> np.ndarray:
    """Places of the targets that differ from a source at an earlier place in 1 to ``most`` bits; a target that is found is not compared any more."""
    sources, left = np.flatnonzero(source), np.flatnonzero(target)
    found, at, width = [], 0, 128
    while at < len(sources) and len(left):
        s = sources[at : at + width]
        left = left[left > s[0]]
        hit = np.zeros(len(left), bool)
        for i in range(0, len(left), 128):
            t = left[i : i + 128]
            near = np.bitwise_count(hashes[t][:, None] ^ hashes[s][None, :]) - np.uint8(1) < most
            if t[0] < s[-1]:
                near &= s[None, :] < t[:, None]
            hit[i : i + 128] = near.any(axis=1)
        found.append(left[hit])
        left = left[~hit]
        at, width = at + width, min(2 * width, 2048)
    return np.concatenate(found) if found else left[:0]


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """The rows with each ``key`` that two near hashes may share."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("hash").bitwiseAND(F.lit(m).cast("bigint"))) for i, m in enumerate(masks)])
    return rows.select("*", F.explode(keys).alias("key"))


def _beaten(rows: DataFrame, most: int, masks: list[int], crowded: DataFrame | None) -> DataFrame:
    """(id): of the ``rows`` (id, hash, kind), those of kind 2 or 3 that an earlier one of kind 1 or 3 is near to.

    Rows meet by the keys of ``near_hashes``, and those with one key are compared
    where they are, so that only ids leave a task.  The rows of a key in ``crowded``
    (key, parts) are dealt into parts, and each two parts meet in a task.
    """
    keyed = _keyed(rows, masks)
    if crowded is None:
        dealt = keyed.withColumn("cell", F.lit(0).cast("bigint"))
    else:
        n, own = F.col("parts"), F.pmod(F.xxhash64("id"), F.col("parts"))
        cells = lambda kind, at: F.transform(F.when(F.col("kind").bitwiseAND(kind) > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct(at(i).alias("cell"), F.lit(kind).alias("kind")))
        several = F.concat(cells(2, lambda i: own * n + i), cells(1, lambda i: i * n + own))
        alone = F.array(F.struct(F.lit(0).cast("bigint").alias("cell"), "kind"))
        dealt = keyed.join(F.broadcast(crowded), "key", "left").select("key", "id", "hash", F.inline(F.when(n.isNull(), alone).otherwise(several)))

    def told(key: np.ndarray, cell: np.ndarray, ids: np.ndarray, hashes: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        size = np.diff(start, append=len(key))
        place, small = np.arange(len(key)) - np.repeat(start, size), np.repeat(size <= SMALL_GROUP, size)
        source, target, beaten = kind & 1 > 0, kind & 2 > 0, np.zeros(len(key), bool)
        back, left = 1, np.flatnonzero(small & target)
        while len(left := left[place[left] >= back]):
            hit = source[left - back] & (np.bitwise_count(hashes[left] ^ hashes[left - back]) - np.uint8(1) < most)
            beaten[left[hit]] = True
            back, left = back + 1, left[~hit]
        for at in np.flatnonzero(size > SMALL_GROUP):
            lo, hi = start[at], start[at] + size[at]
            beaten[lo + _beaten_in_group(hashes[lo:hi], source[lo:hi], target[lo:hi], most)] = True
        return pa.RecordBatch.from_arrays([pa.array(np.unique(ids[beaten]))], names=["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the last cell, whose rows may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns[3] = columns[3].view(np.uint64)
            if held:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            last = np.searchsorted(columns[0], columns[0][-1])
            last += np.searchsorted(columns[1][last:], columns[1][-1])
            if last:
                yield told(*[c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held:
            yield told(*held)

    sent = dealt.select("key", "cell", "id", "hash", F.col("kind").cast("int").alias("kind")).repartition("key", "cell").sortWithinPartitions("key", "cell", "id")
    return sent.mapInArrow(run, "id bigint").distinct()


#: Rows up to which, and share of a round's rows that it must settle or else, all pairs of the rest are listed.
FEW, SETTLED = 1000, 1 / 8


def greedy_hashes(hashes: DataFrame, most: int = 4, few: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(id, kept): in id order, a hash goes when an earlier kept one differs from it in at most ``most`` bits.

    That is ``greedy_dedupe`` over ``near_hashes``, but pairs are not listed, as
    there are too many of them in a large group of near hashes.  Rows that no
    earlier open row is near to are kept, and what they are near to goes, in rounds
    over all tasks.  In any mixed order a few rounds settle nearly all rows.  The
    rest, and rows in long chains that rounds are slow on, are left to the list of
    their pairs.  Equal hashes are one row with their smallest id; ids are whole
    numbers.
    """
    unique = written(hashes.groupBy("hash").agg(F.min("id").cast("bigint").alias("id")).select("id", "hash"))
    rest, kept = unique.where("id IS NOT NULL"), []
    n = rest.count()
    blocks = next((b for b in range(most + 2, 65) if 64 * (b - most) // b > n.bit_length() - TOGETHER), 64)
    masks, crowded = _masks(most, blocks), None
    few = FEW if few is None else few
    counting = True  # until no key is crowded: rows get fewer
    while n > few:
        if counting := counting and n > crowd:
            sizes = _keyed(rest.select("hash"), masks).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd)
            crowded = written(sizes.select("key", F.ceil(F.col("_n") / crowd).alias("parts")))
            counting = not crowded.isEmpty()
        if not counting and crowded is not None:
            discard(crowded)
            crowded = None
        open_ = _beaten(rest.withColumn("kind", F.lit(3)), most, masks, crowded).withColumn("open", F.lit(True))
        marked = written(rest.join(open_, "id", "left").select("id", "hash", F.coalesce("open", F.lit(False)).alias("open")))
        gone = _beaten(marked.select("id", "hash", F.when(F.col("open"), 2).otherwise(1).alias("kind")), most, masks, crowded)
        left = written(marked.where("open").join(gone, "id", "left_anti").select("id", "hash"))
        kept.append(written(marked.where("NOT open").select("id")))
        discard(marked)
        discard(rest)
        before, rest, n = n, left, left.count()
        if before - n < SETTLED * before:
            break
    if n:
        kept.append(greedy_dedupe(rest.select("id"), near_hashes(rest, most)).where("kept").select("id"))
    if not kept:
        return unique.select("id", F.lit(True).alias("kept"))
    found = functools.reduce(DataFrame.unionByName, kept).withColumn("kept", F.lit(True))
    return unique.join(found, "id", "left").select("id", (F.col("id").isNull() | F.col("kept").isNotNull()).alias("kept"))


# ---- rules and diffs -------------------------------------------------------

#: What a pattern that comes as data may not hold: look-around and a quantified group with a quantifier inside.
_UNSAFE = r"\(\?[=!<]|\([^)]*[*+][^)]*\)[*+{]"


def safe_rules(rules: DataFrame, shortest: int = 3, longest: int = 120) -> DataFrame:
    n = F.char_length("pattern")
    return rules.where((n >= shortest) & (n <= longest) & ~F.col("pattern").rlike(_UNSAFE))


#: Rules that one pass over the files can apply.
MOST_RULES = 1000


def apply_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, rule_id): files that match a rule; all safe rules are tried in one pass, and more than ``MOST_RULES`` of them are an error."""
    kept = safe_rules(rules).select("rule_id", "pattern").limit(MOST_RULES + 1).collect()
    if len(kept) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hits = F.array(*[F.when(F.col("content").rlike(r["pattern"]), F.lit(r["rule_id"])) for r in kept]) if kept else F.array().cast("array<string>")
    return files.select("path", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule_id"))


def diff_sides(diffs: DataFrame) -> DataFrame:
    """(path, removed, added): the texts of the two sides of a unified diff, without its headers."""
    lines = F.split("diff", "\n")
    side = lambda sign: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: x.substr(F.lit(2), F.length(x))), "\n")
    return diffs.select("path", side("-").alias("removed"), side("+").alias("added"))


def diff_regressions(diffs: DataFrame, removals: dict[str, str], additions: dict[str, str]) -> DataFrame:
    """(path, kind): protections that a change takes out and does not put back, and weaknesses that it brings in."""
    sides = diff_sides(diffs)
    gone = [F.when(F.col("removed").rlike(p) & ~F.col("added").rlike(p), F.lit(k)) for k, p in removals.items()]
    come = [F.when(F.col("added").rlike(p), F.lit(k)) for k, p in additions.items()]
    return sides.select("path", F.explode(F.array_distinct(F.filter(F.array(*gone, *come), lambda x: x.isNotNull()))).alias("kind"))
