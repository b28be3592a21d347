"""Token ids in wavelet-matrix shards.

Documents are put in ascending doc_id order, encoded, and each run of about
``shard_tokens`` ids becomes one shard: a wavelet matrix, i.e. one bit-plane per
bit of the ids, most significant first, each plane reordering the ids by the
bit before it.  Packed planes and their rank directory answer ``access``,
``rank``, ``select`` and ``occurrences`` from the shard's bytes alone.

Files are Parquet, so that every store Spark knows can hold them: one row a
shard with its order key, counts and the matrix's bytes, beside a manifest that
has each shard's first position in the whole token stream.

``token_counts``, ``token_places`` and ``tokens_at`` answer from the stored shards
by rank, select and access, without undoing a plane.

Null text counts as empty: the document has its end id only.  A null doc_id
comes first.  Rows with equal doc_id are ordered by their text.  A text of any
length is taken whole and lies in one shard, which is then longer than others; a
task holds one shard.  An empty table gives a manifest without rows and empty
results.  Of the columns only doc_id and text are read, whatever the others are
called.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalweave.llm.bpe import batch_encoder, tokenizer_path
from signalweave.llm.store import new_path

MAGIC = b"SWWM0001"
#: Bits that one entry of a plane's rank directory stands for.
BLOCK = 512
#: Ids that close a shard once reached; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 20
#: Text that is encoded in one step, in bytes; a longer text is a step of its own, with what comes after it.
STEP_BYTES = 8 << 20

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """A sequence of unsigned 16-bit ids as succinct bit-planes."""

    def __init__(self, n: int, zeros: np.ndarray, ranks: list[np.ndarray], planes: list[np.ndarray]):
        self.n, self.zeros, self.ranks, self.planes = n, zeros, ranks, planes

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        cur = np.ascontiguousarray(ids, np.uint16)
        zeros, ranks, planes = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (cur & np.uint16(1 << level)).astype(bool)
            packed = np.packbits(ones)
            pad = np.zeros(-(-max(len(packed), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            pad[: len(packed)] = packed
            counts = np.bitwise_count(pad.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4"))
            planes.append(packed)
            # Taking by position is faster than by mask.
            low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
            zeros.append(len(low))
            cur = np.concatenate([cur.take(low), cur.take(high)])
        return cls(len(ids), np.array(zeros, "<u4"), ranks, planes)

    def to_bytes(self) -> bytes:
        head = struct.pack("<IH", self.n, len(self.planes)) + self.zeros.tobytes()
        return head + b"".join(r.tobytes() + p.tobytes() for r, p in zip(self.ranks, self.planes, strict=True))

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        n, bits = struct.unpack_from("<IH", raw)
        zeros = np.frombuffer(raw, "<u4", bits, at := struct.calcsize("<IH"))
        at += 4 * bits
        size = (n + 7) // 8
        blocks = -(-max(size, 1) // (BLOCK // 8)) + 1
        ranks, planes = [], []
        for _ in range(bits):
            ranks.append(np.frombuffer(raw, "<u4", blocks, at))
            at += 4 * blocks
            planes.append(np.frombuffer(raw, np.uint8, size, at))
            at += size
        return cls(n, zeros, ranks, planes)

    def _ones_before(self, level: int, i: int) -> int:
        block = i // BLOCK
        plane, begin = self.planes[level], block * (BLOCK // 8)
        count = int(self.ranks[level][block]) + int(_POP[plane[begin : i // 8]].sum())
        return count + (bin(int(plane[i // 8]) >> (8 - i % 8)).count("1") if i % 8 else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, plane in enumerate(self.planes):
            bit = (int(plane[i // 8]) >> (7 - i % 8)) & 1
            ones = self._ones_before(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            out = 2 * out + bit
        return out

    def _span(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._ones_before(level, lo), self._ones_before(level, hi)
            if (symbol >> (len(self.planes) - 1 - level)) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of an id before position i."""
        lo, hi = self._span(symbol, 0, i)
        return hi - lo

    def count(self, symbol: int, lo: int, hi: int) -> int:
        a, b = self._span(symbol, lo, hi)
        return b - a

    def _place(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this kind in a plane."""
        ranks, plane = self.ranks[level], self.planes[level]
        have = ranks if bit else np.arange(len(ranks), dtype=np.int64) * BLOCK - ranks
        block = int(np.searchsorted(have, k, "right")) - 1
        begin = block * (BLOCK // 8)
        bits = np.unpackbits(plane[begin : begin + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(have[block])])

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        lo, hi = self._span(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = (symbol >> (len(self.planes) - 1 - level)) & 1
            i = self._place(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def occurrences(self, symbol: int, lo: int = 0, hi: int | None = None) -> list[int]:
        first = self.rank(symbol, lo)
        return [self.select(symbol, first + k) for k in range(self.count(symbol, lo, self.n if hi is None else hi))]

    def extract(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        cur = np.zeros(self.n, np.uint16)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            back = np.empty(self.n, np.uint16)
            cut = int(self.zeros[level])
            back[np.flatnonzero(~ones)] = cur[:cut]
            back[np.flatnonzero(ones)] = cur[cut:] | np.uint16(1 << (len(self.planes) - 1 - level))
            cur = back
        return cur


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    table = numbers.tobytes() + np.array(lengths, "<u4").tobytes() + known.tobytes()
    return MAGIC + struct.pack("<I", len(doc_ids)) + table + WaveletMatrix.build(ids).to_bytes()


def unpack_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc ids, lengths, matrix."""
    if raw[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    (n,) = struct.unpack_from("<I", raw, 8)
    numbers, lengths = np.frombuffer(raw, "<i8", n, 12), np.frombuffer(raw, "<u4", n, 12 + 8 * n)
    known = np.frombuffer(raw, np.uint8, n, 12 + 12 * n)
    ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
    return ids, lengths, WaveletMatrix.from_bytes(raw[12 + 13 * n :])


def _steps(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch of doc_id and text where another ``limit`` bytes of text are full."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(sizes // limit)) + 1
    for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def write_token_shards(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> str:
    """Writes shards and manifest below ``path`` and returns it."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    tokenizer = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = batch_encoder(tokenizer), TaskContext.get().partitionId()
        doc_ids, lengths, held, size, seq = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(held)
            raw = pack_shard(doc_ids, lengths, ids)
            arrays = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for rows in _steps(batch, STEP_BYTES):
                ids, bounds = coder.encode(rows.column(1))
                ids = np.insert(ids, bounds[1:], end_id)
                numbers, counts = rows.column(0).to_pylist(), np.diff(bounds) + 1
                ends, first, begin = np.cumsum(counts), 0, 0
                while first < len(ends):
                    # To the document that fills the shard, or to the end of the step.
                    last = min(int(np.searchsorted(ends, begin + shard_tokens - size)) + 1, len(ends))
                    end = int(ends[last - 1])
                    doc_ids += numbers[first:last]
                    lengths += counts[first:last].tolist()
                    held.append(ids[begin:end])
                    size += end - begin
                    first, begin = last, end
                    if size >= shard_tokens:
                        yield shard()
                        doc_ids, lengths, held, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield shard()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(run, "part int, seq int, n_docs bigint, n_tokens bigint, payload binary")
    shards.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(f"{path}/shards")
    # Two levels, so that no single task sums over all shards of a large corpus.
    counts = spark.read.parquet(f"{path}/shards").select("part", "seq", "n_tokens")
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = counts.withColumn("inside", inside).join(parts.select("part", before.alias("before")), "part")
    manifest.select("part", "seq", "n_tokens", (F.col("inside") + F.col("before")).alias("start")).write.parquet(f"{path}/manifest")
    return path


def read_token_shards(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with ``tokens``, the ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, matrix = unpack_shard(batch.column(2)[i].as_py())
                ids = matrix.extract().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                cut = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                arrays = [pa.array([batch.column(0)[i].as_py()] * n, pa.int32()), pa.array([batch.column(1)[i].as_py()] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64())]
                names = ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if tokens:
                    arrays.append(pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    more = ", ids array<int>" if tokens else ""
    read = spark.read.parquet(f"{path}/shards").select("part", "seq", "payload")
    docs = read.mapInArrow(run, f"part int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint{more}")
    starts = spark.read.parquet(f"{path}/manifest").select("part", "seq", F.col("start").alias("shard_start"))
    out = docs.join(starts, ["part", "seq"])
    return out.select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if tokens else []))


def _on_shards(spark: SparkSession, path: str, answer, schema: str, among: str = "true") -> DataFrame:
    """Runs ``answer(start, matrix)`` on the shards that fulfil a condition on their ``start`` and ``n_tokens``; it gives columns in the order of the schema."""
    fields = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns = answer(start, unpack_shard(payload.as_py())[2])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=fields)

    starts = spark.read.parquet(f"{path}/manifest").where(among).select("part", "seq", "start")
    shards = spark.read.parquet(f"{path}/shards").select("part", "seq", "payload").join(starts, ["part", "seq"])
    return shards.select("start", "payload").mapInArrow(run, schema)


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of a few ids comes in all shards; by two ranks a plane and shard."""
    asked = sorted(set(tokens))
    found = _on_shards(spark, path, lambda _, m: (asked, [m.count(t, 0, m.n) for t in asked]), "token bigint, n bigint")
    counted = found.groupBy("token").agg(F.sum("n").alias("n"))
    every = spark.createDataFrame([(t,) for t in asked], "token bigint")
    return every.join(counted, "token", "left").fillna(0, ["n"])


def token_places(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, place: all places of each of a few ids in the whole token stream, by select."""
    asked = sorted(set(tokens))

    def places(start: int, m: WaveletMatrix) -> tuple[list[int], list[int]]:
        found = [(t, start + i) for t in asked for i in m.occurrences(t)]
        return [t for t, _ in found], [i for _, i in found]

    return _on_shards(spark, path, places, "token bigint, place bigint")


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """place, token: the ids at a few places of the whole stream, by access; only the shards that hold them are read. Places beyond the stream have no row."""
    asked = np.unique(np.array(places, np.int64))

    def at(start: int, m: WaveletMatrix) -> tuple[list[int], list[int]]:
        inside = asked[(asked >= start) & (asked < start + m.n)].tolist()
        return inside, [m.access(i - start) for i in inside]

    listed = ", ".join(f"{i}L" for i in asked.tolist())
    return _on_shards(spark, path, at, "place bigint, token bigint", f"exists(array({listed}), p -> p >= start AND p < start + n_tokens)" if listed else "false")
