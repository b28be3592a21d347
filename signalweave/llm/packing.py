"""Packing documents into sequences of bounded length, online and in bounded space.

A document is its ids and an end id.  Each partition keeps ``windows`` open
sequences.  What a document has beyond whole sequences, its rest, goes where it
fits best, that is to the open window with the least sufficient room.  Where
none has room the fullest window is emitted: it is closed if at most ``slack``
places are free in it, else the head of the rest fills it and the remainder is
placed anew.  So a worker holds ``windows`` sequences, however many documents
come.

What is open at a partition's end is merged in turn, full windows first, to at
most one unfinished window a partition.  These meet in rounds, ``FAN`` partitions
a group, each group packed again in the same way, until one group is left; its
last window falls into windows of powers of two, which need no padding.  A round
handles at most ``FAN`` unfinished windows a task.

No shuffle but that of unfinished windows.  Sequences are named by round, place
of the partition and a running number, so a task that runs again gives the same.
Null and empty texts are one end id.  Documents with equal or no doc_id are
separate documents.  Texts of any length are taken whole; a worker holds the
largest a few times.  An empty table gives an empty result.  Of the columns only
the text and those named by ``keep`` are read, whatever the others are called.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.bpe import byte_encoder, tokenizer_path
from signalweave.llm.store import materialize
from signalweave.llm.text import slices

SIZE = 1024
WINDOWS = 64
#: Places that a window may leave free when it is closed.
SLACK = 4
#: Partitions whose unfinished windows meet in one task.
FAN = 256
#: Ids of pieces that a worker gathers before it hands them on.
HELD = 1 << 20


class Packer:
    """Windows of at most ``size`` ids, from pieces (document, start, ids)."""

    def __init__(self, size: int, windows: int, slack: int, first: int):
        self.size, self.windows, self.slack = size, windows, slack
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.open: dict[int, list[tuple]] = {}
        self.made, self.next = 0, first
        self.closed: list[tuple[int, list[tuple]]] = []
        self.held = 0

    def _close(self, pieces: list[tuple]) -> None:
        self.closed.append((self.next, pieces))
        self.held += sum(len(p[2]) for p in pieces)
        self.next += 1

    def add(self, document: tuple, start: int, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.size
        for at in range(0, whole, self.size):
            self._close([(document, start + at, ids[at : at + self.size])])
        start, ids = start + whole, ids[whole:]
        while len(ids):
            at = bisect_left(self.rooms, (len(ids), -1))
            if at < len(self.rooms):
                self._put(at, (document, start, ids))
                return
            if len(self.rooms) == self.windows:
                room = self.rooms[0][0]
                if room > self.slack:
                    self._put(0, (document, start, ids[:room]))
                    start, ids = start + room, ids[room:]
                    continue
                self._close(self.open.pop(self.rooms.pop(0)[1]))
            self.open[self.made] = []
            insort(self.rooms, (self.size, self.made))
            self.made += 1

    def _put(self, at: int, piece: tuple) -> None:
        room, window = self.rooms.pop(at)
        self.open[window].append(piece)
        room -= len(piece[2])
        if room:
            insort(self.rooms, (room, window))
        else:
            self._close(self.open.pop(window))

    def merge(self, last: bool) -> list[tuple]:
        """Closes what can be filled; gives the pieces of the window that remains, or closes it too in powers of two."""
        rest: list[tuple] = []
        room = self.size
        for _, window in self.rooms:
            for document, start, ids in self.open[window]:
                while len(ids):
                    rest.append((document, start, ids[:room]))
                    start, ids, room = start + len(rest[-1][2]), ids[room:], room - len(rest[-1][2])
                    if not room:
                        self._close(rest)
                        rest, room = [], self.size
        self.rooms, self.open = [], {}
        if not last:
            return rest
        while rest:
            room = 1 << (sum(len(p[2]) for p in rest).bit_length() - 1)
            part = []
            while room:
                document, start, ids = rest.pop(0)
                part.append((document, start, ids[:room]))
                if len(ids) > room:
                    rest.insert(0, (document, start + room, ids[room:]))
                room -= len(part[-1][2])
            self._close(part)
        return []

    def taken(self) -> list[tuple[int, list[tuple]]]:
        closed, self.closed, self.held = self.closed, [], 0
        return closed


def _batch(sequences: list[tuple[int, list[tuple]]], part: int, unfinished: bool, schema: pa.Schema) -> pa.RecordBatch:
    """A document in a piece is (values of the kept columns, number of its ids)."""
    columns: list[list] = [[] for _ in schema]
    n = len(schema) - 7
    for name, pieces in sequences:
        offset = 0
        for (values, total), start, ids in pieces:
            row = (*values, start, len(ids), total, name, offset, ids.astype("<u4", copy=False).tobytes(), part if unfinished else None)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += len(ids)
    arrays = [pa.array(c, f.type) for c, f in zip(columns[:n], list(schema)[:n], strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, *[pa.array(c, f.type) for c, f in zip(columns[n:], list(schema)[n:], strict=True)]], schema=schema)


_PIECE = "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, part bigint"
_PIECE_TYPES = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64())]


def _first(turn: int, part: int) -> int:
    """Names of the sequences of a partition in a round begin here: 7 rounds, 2^28 partitions, 2^32 sequences in each."""
    return ((turn << 28) + part) << 32


def _pack_texts(docs: DataFrame, keep: tuple[str, ...], path: str, end: int, size: int, windows: int, slack: int) -> DataFrame:
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, schema = byte_encoder(path), TaskContext.get().partitionId(), None
        packer = Packer(size, windows, slack, _first(0, part))
        for batch in batches:
            schema = pa.schema([*[(f"k{i}", batch.schema[i].type) for i in range(n)], *_PIECE_TYPES])
            for rows, raws in slices(batch, "_text"):
                values = zip(*[rows.column(i).to_pylist() for i in range(n)], strict=True) if n else iter([()] * len(raws))
                for value, ids in zip(values, coder.encode(raws), strict=True):
                    packer.add((value, len(ids) + 1), 0, np.append(ids, np.uint32(end)))
                    if packer.held > HELD:
                        yield _batch(packer.taken(), part, False, schema)
        if schema is not None:
            rest = packer.merge(False)
            yield _batch(packer.taken(), part, False, schema)
            if rest:
                yield _batch([(_first(0, part), rest)], part, True, schema)

    types = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["text"].alias("_text")).mapInArrow(run, types + _PIECE)


def _pack_again(left: DataFrame, n: int, turn: int, groups: int, size: int, windows: int, slack: int) -> DataFrame:
    """One round: the unfinished windows of ``FAN`` partitions are packed together; the last round leaves none."""
    last = groups == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at, schema = None, None, None

        def finished() -> Iterator[pa.RecordBatch]:
            rest = packer.merge(last)
            yield _batch(packer.taken(), at, False, schema)
            if rest:
                yield _batch([(_first(turn, at), rest)], at, True, schema)

        for batch in batches:
            schema = batch.schema.remove(len(batch.schema) - 1)
            group = batch.column(len(schema)).to_pylist()
            columns = [batch.column(i).to_pylist() for i in range(len(schema))]
            for i, g in enumerate(group):
                if g != at:
                    if packer is not None:
                        yield from finished()
                    packer, at = Packer(size, windows, slack, _first(turn, g)), g
                values = tuple(c[i] for c in columns[:n])
                start, _, total, _, _, ids, _ = (c[i] for c in columns[n:])
                packer.add((values, total), start, np.frombuffer(ids, "<u4"))
        if packer is not None:
            yield from finished()

    group = F.floor(F.col("part") / FAN).cast("bigint")
    dealt = left.withColumn("grp", group).repartition(groups, "grp").sortWithinPartitions("grp", "part", "offset")
    return dealt.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema))


def pack(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), size: int = SIZE, end: int = 0, windows: int = WINDOWS, slack: int = SLACK) -> DataFrame:
    """``keep`` columns, start, length, doc_tokens, sequence_id, offset, ids: the pieces of all sequences.

    ``ids`` are little-endian 32-bit integers; ``offset`` is a piece's place in
    its sequence, ``start`` its place in its document of ``doc_tokens`` ids.
    ``size`` is a power of two.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("the size of a sequence is a power of two")
    names = [*keep, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    if len(set(names)) < len(names):
        raise ValueError("a kept column has the name of one of the result")
    path = path or tokenizer_path("byte_bpe_50k.json")
    left = materialize(_pack_texts(docs, keep, path, end, size, windows, slack), "packed")
    found, turn = left.where(F.col("part").isNull()), 0
    most = left.agg(F.max("part")).first()[0]
    while most is not None:
        groups, turn = most // FAN + 1, turn + 1
        left = materialize(_pack_again(left.where(F.col("part").isNotNull()), len(keep), turn, groups, size, windows, slack), "packed")
        found = found.unionByName(left.where(F.col("part").isNull()))
        most = left.agg(F.max("part")).first()[0]
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[len(keep) :])


def sequences(pieces: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids: whole sequences, padded to ``size`` unless their length is a power of two."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(inside, F.unhex(F.lit("")), lambda out, piece: F.concat(out, piece["ids"])).alias("ids"))
    power = F.bit_count("n_tokens") == 1
    filled = F.rpad("ids", F.lit(4 * size), F.lit(int(pad).to_bytes(4, "little")))
    return whole.select("sequence_id", "n_tokens", F.when(power, F.col("ids")).otherwise(filled).alias("ids"))
