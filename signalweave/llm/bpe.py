"""Byte-pair encoding of words with a public tokenizer file.

The tokenizer drops white space before it cuts text into pieces, so no token
crosses an ASCII space: the ids of a text are the ids of its words in order.
Words of letters, digits and signs from ASCII and Latin-1 / Latin Extended-A
are cut by an equivalent pattern and given to the library's BPE model at once;
every other word goes through the library's whole encoder.  ``BatchEncoder``
takes many texts at once, and each of their distinct words once.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from signalweave.llm.text import Words, mixed

#: Latin letters whose normal form is themselves and whose lower case is one letter.
_LATIN = "À-ÖØ-öø-į"
_LOWER = "ß-öø-ÿā-į"
_PLAIN = re.compile(f"[\x21-\x7e{_LATIN}]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + spare)
            spare += 1
    return [out[b] for b in range(256)]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes that a remembered word takes beside its characters and ids, about.
ENTRY = 150


class Memory:
    """Bytes by word or piece, the lately used ones: what is not asked for while ``limit`` bytes come in is forgotten."""

    def __init__(self, limit: int):
        self.new: dict = {}
        self.old: dict = {}
        self.held, self.limit = 0, limit // 2

    def find(self, key: str | bytes) -> bytes | None:
        got = self.old.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key: str | bytes, ids: bytes) -> None:
        size = ENTRY + len(key) + len(ids)
        if size > self.limit // 64:
            return
        self.held += size
        if self.held > self.limit:
            self.old, self.new, self.held = self.new, {}, size
        self.new[key] = ids


class WordEncoder:
    """word (UTF-8 bytes) -> ids as uint16 bytes, little-endian.

    ``memory`` bounds the bytes of words, and of pieces of words, remembered in a
    worker; what is forgotten is encoded anew, so the result does not depend on it.
    """

    def __init__(self, path: str, memory: int = 140 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = _byte_letters()
        self.words, self.pieces = Memory(memory), Memory(memory // 4)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.find(piece)
        if got is None:
            got = self._cut(piece)
            self.pieces.put(piece, got)
        return got

    def _cut(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return _bytes([t.id for t in self.model.tokenize(shown)])

    def _word(self, word: bytes) -> bytes:
        got = self.words.find(word)
        if got is not None:
            return got
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            got = self._cut(text.lower())
        elif _PLAIN.fullmatch(text) and "<|" not in text:
            found = _PIECES.findall(text.lower())
            if len(found) == 1:  # remembered as a word
                got = self._cut(found[0])
            else:
                known = self.pieces.new
                got = b"".join([known.get(p) or self._piece(p) for p in found])
        else:
            got = _bytes(self.library.encode(text, add_special_tokens=False).ids)
        self.words.put(word, got)
        return got

    def encode(self, raw: bytes) -> bytes:
        """ids of a whole text, as uint16 bytes."""
        out = list(map(self.words.new.get, found := raw.split()))
        if None in out:
            # Most texts have a few words that are not lately remembered: only those are looked at one by one.
            for i in [i for i, x in enumerate(out) if x is None]:
                out[i] = self.words.new.get(found[i]) or self._word(found[i])
        return b"".join(out)


def _bytes(ids: list[int]) -> bytes:
    got = array("H", ids)
    if sys.byteorder == "big":
        got.byteswap()
    return got.tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, which Spark keeps for many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


#: Control characters but the line feed, and first bytes of characters that may be white space.
_CONTROL, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_CONTROL[[*range(0x0A), *range(0x0B, 0x20), 0x7F]] = True
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1[\x9a\xa0]|\xe2[\x80\x81]|\xe3\x80")
#: Texts with a word longer than this go to the library whole.
_LONG = 255


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several runs, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class ByteEncoder:
    """Texts (UTF-8 bytes) -> ids, for byte-level vocabularies with the usual pattern.

    That pattern begins a piece at a space between visible characters, and a line
    feed between visible characters is a piece of its own.  So where a text has no
    other white space its ids are those of its words, each with or without the
    space before it.  Words are told apart by hash, for all texts of a call at once;
    new ones are encoded together and parted by the bytes that each token stands
    for.  The bytes of every word are compared with those that its hash is known
    for, so ids never depend on a hash.  Other texts are encoded whole.

    ``memory`` bounds the bytes of remembered words; results do not depend on it.
    """

    def __init__(self, path: str, memory: int = 100 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        special = {t["content"] for t in read["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        vocabulary = read["model"]["vocab"]
        ranks = {bytes(map(byte_of.__getitem__, k)): i for k, i in vocabulary.items() if k not in special}
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in read["model"]["merges"]]
        before = read["pre_tokenizer"] or {}
        if merged != sorted(merged) or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or read["normalizer"]:
            raise ValueError(f"{path} is not a byte-level vocabulary in the order of its merges")
        self.special = [k.encode() for k in special]
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.widths[list(ranks.values())] = [len(k) for k in ranks]
        self.line = ranks[b"\n"]
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        """No word is known: ``keys`` in order, where each one's ids and bytes begin and how many they are, and all ids and bytes."""
        self.keys = np.empty(0, np.uint64)
        self.places = np.empty((4, 0), np.int64)
        self.ids, self.bytes = np.empty(0, np.uint32), np.empty(0, np.uint8)

    def _learn(self, keys: np.ndarray, units: list[bytes], lengths: np.ndarray) -> None:
        """Units begin with a space, or with a line feed that is not part of them."""
        ids = np.array(self.ranked.encode_ordinary(b"".join(units).decode()), np.uint32)
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(lengths)) + 1
        raw = np.frombuffer(b"".join(units), np.uint8)
        starts = np.concatenate([[0], ends[:-1]]) + (raw[np.cumsum(lengths) - lengths] == 0x0A)
        places = np.stack([starts + len(self.ids), ends - starts, np.cumsum(lengths) - lengths + 1 + len(self.bytes), lengths - 1])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.places = np.insert(self.places, at, places[:, order], axis=1)
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, raw])

    def _plain(self, raws: list[bytes]) -> list[int]:
        """Texts that are words parted by single spaces or line feeds, of which none is very long."""
        words = Words(raws)
        codes = words.codes
        space = (codes == 0x20) | (codes == 0x0A)
        pairs = np.flatnonzero(space[1:] & space[:-1])
        wide = [m.start() for m in _WIDE_SPACE.finditer(words.data)] if _LEAD[codes].any() else []
        odd = np.concatenate([np.flatnonzero(_CONTROL[codes]), pairs, pairs + 1, wide, words.first[words.last - words.first > _LONG]]).astype(np.int64)
        starts = np.cumsum([0, *[len(t) + 1 for t in raws]])
        whole = set(np.searchsorted(starts, odd, "right").tolist())
        return [i for i, raw in enumerate(raws) if raw and i + 1 not in whole and not any(s in raw for s in self.special) and _valid(raw)]

    def _words(self, raws: list[bytes]) -> list[np.ndarray] | None:
        """The ids of plain texts; None if two words have one hash."""
        words = Words(raws)
        begin = np.zeros(len(words.first) + 1, bool)
        begin[words.bounds[:-1]] = True
        apart = words.codes[words.first - 1]
        spaced, line = (apart == 0x20) & ~begin[:-1], (apart == 0x0A) & ~begin[:-1]
        keys = mixed(words.hashes() + spaced.astype(np.uint64))
        each, one, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, each), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != each) if len(self.keys) else np.arange(len(each))
        if len(new):
            units = [(b" " if s else b"\n") + words.data[a:b] for s, a, b in zip(spaced[one[new]].tolist(), words.first[one[new]].tolist(), words.last[one[new]].tolist(), strict=True)]
            self._learn(each[new], units, (words.last - words.first)[one[new]] + 1)
            at = np.searchsorted(self.keys, each)
        id_start, n_ids, byte_start, n_bytes = self.places[:, at][:, which]
        long = words.last - words.first
        if not np.array_equal(n_bytes, long) or not np.array_equal(self.bytes[ragged(byte_start, long)], words.codes[ragged(words.first, long)]):
            return None
        ends = np.cumsum(n_ids + line)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        starts = ends - n_ids
        out[starts[line] - 1] = self.line
        out[ragged(starts, n_ids)] = self.ids[ragged(id_start, n_ids)]
        bounds = np.concatenate([[0], ends])[words.bounds]
        if self.keys.nbytes + self.places.nbytes + self.ids.nbytes + self.bytes.nbytes > self.memory:
            self._forget()
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _whole(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "replace")
        if max(map(len, raw.split()), default=0) > _LONG or any(s in raw for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranked.encode_ordinary(text), np.uint32)

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, in order."""
        plain = self._plain(raws)
        found = self._words([raws[i] for i in plain]) if plain else []
        done = dict(zip(plain, found, strict=True)) if found is not None else {}
        return [done[i] if i in done else self._whole(raw) for i, raw in enumerate(raws)]


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_byte_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One per Python worker, which Spark keeps for many tasks."""
    if path not in _byte_encoders:
        _byte_encoders[path] = ByteEncoder(path)
    return _byte_encoders[path]


#: What two bytes in a row say of a word: that a piece ends between them, or that the word is not plain.
_CUT, _ODD = 1, 2


def _pair_marks() -> np.ndarray:
    """The marks of two bytes, at 256 * first + second, where line feeds part words."""
    kind = np.full(256, 3, np.uint8)
    kind[0x0A] = 0
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    kind[0x30:0x3A] = 2
    first, second = np.divmod(np.arange(1 << 16), 256)
    cut = (kind[first] > 0) & (kind[second] > 0) & ((kind[first] != kind[second]) | (kind[second] == 2))
    # As in ``_LATIN``: U+00C0 to U+012F without the signs of multiplication and division.
    latin = (first == 0xC3) & (second >= 0x80) & (second < 0xC0) & ~np.isin(second, [0x97, 0xB7])
    latin |= (first == 0xC4) & (second >= 0x80) & (second < 0xB0)
    begins = (second > 0x20) & (second < 0x7F) | np.isin(second, [0x0A, 0xC3, 0xC4])
    odd = np.where(np.isin(first, [0xC3, 0xC4]), ~latin, ~begins)
    odd |= (first == ord("'")) & np.isin(second, list(b"stmdrvlSTMDRVL"))
    odd |= (first == ord("<")) & (second == ord("|"))
    return (cut * _CUT + odd * _ODD).astype(np.uint8)


class BatchEncoder:
    """Texts -> ids as uint16, for the tokenizers of ``WordEncoder``; of equal words in a call one is encoded.

    Plain words are cut into pieces by their bytes, and all pieces encoded
    together, with a line feed for the vocabulary's mark of a word's end.  Words of
    other letters, those that may hold a contraction or a special token, and long
    ones go to ``WordEncoder`` one by one.  No plain word is remembered between calls.
    """

    def __init__(self, path: str):
        import tiktoken

        self.words = encoder(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, mark, letters = model["vocab"], model.get("end_of_word_suffix"), _byte_letters()
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if not mark or merged != sorted(set(merged)) or merged[0] <= max(vocabulary.get(x, len(vocabulary)) for c in letters for x in (c, c + mark)):
            raise ValueError(f"{path} is not a vocabulary of words in the order of its merges")
        byte_of = {c: b for b, c in enumerate(letters)}
        ranks = {}
        for token, i in vocabulary.items():
            last = token.endswith(mark)
            raw = bytes(map(byte_of.__getitem__, token[: -len(mark)] if last else token))
            if b"\n" not in raw:
                ranks[raw + b"\n" * last] = i
        self.ranked = tiktoken.Encoding("pieces", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        self.last = np.zeros(max(ranks.values()) + 1, bool)
        self.last[[i for raw, i in ranks.items() if raw.endswith(b"\n")]] = True
        self.marks = _pair_marks()

    def _table(self, words: pa.StringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The ids of distinct words, and the place of each word's there."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], "<i4", n + 1, 4 * words.offset)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        lengths = np.diff(offsets)
        codes = np.insert(raw, offsets[1:], 0x0A)
        pairs = codes.astype(np.uint16)
        pairs[1:] |= pairs[:-1] << np.uint16(8)
        pairs[:1] |= 0x0A00
        marks = self.marks[pairs]
        odd = (lengths == 0) | (lengths > _LONG)
        odd[np.searchsorted(offsets[1:] + np.arange(n), np.flatnonzero(marks & _ODD))] = True
        single = np.flatnonzero(odd)
        if len(single):
            kept = np.repeat(~odd, lengths + 1)
            codes, marks, lengths = codes[kept], marks[kept], lengths[~odd]
        cuts = np.flatnonzero(marks & _CUT)
        pieces = np.insert(codes, cuts, 0x0A).tobytes().decode().lower()
        ids = self.ranked.encode_to_numpy(pieces, disallowed_special=()).astype("<u2")
        # A word ends with the last of its pieces, a piece with an id that holds the mark.
        ends = np.cumsum(lengths + 1)
        stops = (np.flatnonzero(self.last[ids]) + 1)[np.arange(len(ends)) + np.searchsorted(cuts, ends)]
        plain = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.concatenate([[0], 2 * stops]).astype("<i8")), pa.py_buffer(ids)])
        others = [self.words._word(w) for w in words.take(pa.array(single)).cast(pa.binary()).to_pylist()]
        place = np.empty(n, np.int64)
        place[~odd], place[single] = np.arange(len(stops)), len(stops) + np.arange(len(single))
        return pa.concat_arrays([plain, pa.array(others, pa.large_binary())]), place

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, in order, and how many of them come before each text and in all; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words = split.flatten().dictionary_encode()
        table, place = self._table(words.dictionary)
        found = table.take(pa.array(place[words.indices.to_numpy()]))
        offsets = np.frombuffer(found.buffers()[1], "<i8", len(found) + 1, 8 * found.offset) // 2
        ids = np.frombuffer(found.buffers()[2] or b"", "<u2", offsets[-1])
        first = split.offsets.to_numpy()
        return ids, offsets[first - first[0]]


_batch_encoders: dict[str, BatchEncoder] = {}


def batch_encoder(path: str) -> BatchEncoder:
    """One per Python worker, which Spark keeps for many tasks."""
    if path not in _batch_encoders:
        _batch_encoders[path] = BatchEncoder(path)
    return _batch_encoders[path]
