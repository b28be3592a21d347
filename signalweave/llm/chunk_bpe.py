"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes of a text marks chunk ends, so passages that
documents share are cut at the same places wherever they stand.  A chunk is
encoded once and remembered; when it appears again, in the same or another
document, its ids are reused.  At a join the tokens of the two sides need not be
those of the whole text, so each join is re-encoded over a growing stretch until
it agrees with the ids on both sides: the stretch grows to the nearest white
space on either side, which no token of this tokenizer crosses, and there the
ids of both neighbours hold exactly.

Null text is encoded as empty text: no ids, the hash of the empty string.
Repeated rows give repeated rows, with or without a doc_id; an empty table gives an
empty result.  Texts of any length are taken whole; a task holds the largest a few
times.  Of the columns only text and those named by ``keep`` are read, whatever the
others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalweave.llm.bpe import WordEncoder, tokenizer_path
from signalweave.llm.text import slices

#: A chunk ends where the rolling hash of the last 16 bytes has these bits zero: 512 bytes on average.
END_BITS = 9
#: Bytes of chunks that a worker remembers before it starts anew; bounds memory, not results.
CHUNK_MEMORY = 20 << 20
#: Bytes of words that it remembers; workers live for many tasks and several of them share an executor's memory.
WORD_MEMORY = 40 << 20

_WS = b" \t\n\v\f\r"
_TABLE = np.random.default_rng(20240229).integers(1, 2**32, 256, dtype=np.uint32)


def chunk_ends(raw: np.ndarray, bits: int = END_BITS) -> np.ndarray:
    """Positions after which a chunk ends; a position depends on 16 bytes only."""
    if len(raw) < 32:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = _TABLE[raw]
        width, mult = 1, np.uint32(0x2545F491)
        while width < 16:
            h = h[width:] + h[:-width] * mult
            width *= 2
            mult = mult * mult
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
    ends = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0) + 16
    ends = ends[ends < len(raw)]
    return ends[(raw[ends] & 0xC0) != 0x80]  # never inside a character


class ChunkEncoder:
    """Encodes texts by chunks, remembers chunks, decodes ids."""

    def __init__(self, words: WordEncoder):
        self.words = words
        size = words.library.get_vocab_size()
        self.tokens = [(words.library.id_to_token(i) or "").encode() for i in range(size)]
        self.numbers = [str(i).encode() for i in range(size)]
        self.chunks: dict[bytes, tuple] = {}
        self.held = 0
        self.reused = 0

    def _shown(self, ids: bytes) -> tuple[int, bytes, bytes]:
        """n, decimal ids and decoded text of a run of ids, each joined by spaces."""
        got = np.frombuffer(ids, "<u2").tolist()
        return len(got), b" ".join(map(self.numbers.__getitem__, got)), b" ".join(map(self.tokens.__getitem__, got))

    def _chunk(self, raw: bytes) -> tuple:
        """(head, body, tail): text before the first and after the last white space, and what lies between, encoded.

        A chunk without white space is all head: (raw, None, None).
        """
        got = self.chunks.get(raw)
        if got is not None:
            self.reused += 1
            return got
        inner = raw.lstrip(_WS)
        if len(inner) < len(raw):
            head, rest = b"", inner
        else:
            cut = raw.split(None, 1)
            if len(cut) < 2:
                head = cut[0] if cut else b""
                rest = None if len(head) == len(raw) else b""
            else:
                head, rest = cut
        if rest is None:
            got = (raw, None, None)
        else:
            stripped = rest.rstrip(_WS)
            if len(stripped) < len(rest) or not rest:
                body, tail = stripped, b""
            else:
                cut = rest.rsplit(None, 1)
                body, tail = cut if len(cut) == 2 else (b"", rest)
            got = (head, self._shown(self.words.encode(body)), tail)
        self.held += 2 * len(raw) + 200
        if self.held > CHUNK_MEMORY:
            self.chunks.clear()
            self.held = 0
        self.chunks[raw] = got
        return got

    def encode(self, raw: bytes, ends: list[int]) -> list[tuple[int, bytes, bytes]]:
        """The encoded runs of a text in order; no run is empty."""
        out, open_word = [], []  # the open word in pieces
        begin = 0
        for end in [*ends, len(raw)]:
            head, body, tail = self._chunk(raw[begin:end])
            begin = end
            if body is None:
                open_word.append(head)
                continue
            open_word.append(head)
            if any(open_word):
                out.append(self._shown(self.words.encode(b"".join(open_word))))
            out.append(body)
            open_word = [tail]
        if any(open_word):
            out.append(self._shown(self.words.encode(b"".join(open_word))))
        return [x for x in out if x[0]]


_made: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _made:
        _made[path] = ChunkEncoder(WordEncoder(path, WORD_MEMORY))
    return _made[path]


def encode_texts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), texts: bool = True, decoded: bool = True) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, with ``texts``, ids (array) and, with ``decoded`` too, decoded (string).

    One pass over the rows, no shuffle.
    """
    path = path or tokenizer_path()
    cols = [docs[c] for c in keep]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    decoded = texts and decoded
    extra = (", ids array<int>" if texts else "") + (", decoded string" if decoded else "")
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * texts, *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        for batch in batches:
            for part, raws in slices(batch):
                counts, idsums, textsums, all_ids, all_texts = [], [], [], [], []
                for raw in raws:
                    ends = chunk_ends(np.frombuffer(raw, np.uint8)).tolist()
                    runs = coder.encode(raw, ends)
                    shown, text = b" ".join([x[1] for x in runs]), b" ".join([x[2] for x in runs])
                    counts.append(sum(x[0] for x in runs))
                    idsums.append(hashlib.sha256(shown).hexdigest())
                    textsums.append(hashlib.sha256(text).hexdigest())
                    if texts:
                        all_ids.append(np.fromstring(shown, np.int32, sep=" "))
                    if decoded:
                        all_texts.append(text.decode())
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(counts, pa.int64()), pa.array(idsums, pa.string()), pa.array(textsums, pa.string())]
                if texts:
                    arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                if decoded:
                    arrays.append(pa.array(all_texts, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*cols, docs["text"]).mapInArrow(run, f"{types}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
