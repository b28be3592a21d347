"""Words and their hashes, for use inside tasks.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D.
``bytes.split()`` without arguments cuts UTF-8 text at exactly these bytes, and
so does ``Words``, for the texts of a whole batch in a few vector passes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Text that is looked at in one vectorised step, in bytes.
STEP_BYTES = 1 << 20
U64 = np.uint64


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts a batch into parts of about ``limit`` bytes of text; null text counts as empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    first, held, part = 0, 0, []
    for i, value in enumerate(texts):
        raw = value.as_py() or b""
        part.append(raw)
        held += len(raw)
        if held >= limit:
            yield batch.slice(first, i + 1 - first), part
            first, held, part = i + 1, 0, []
    if part:
        yield batch.slice(first), part


_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes of one vectorised step of the word hashes, and of the longest word that they take.
_CHUNK, _LONGEST = 1 << 17, 255
_BASE = 0x9E3779B97F4A7C15
#: A random odd number for each byte value, and the powers of the base and of its inverse modulo 2^64.
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _CHUNK + _LONGEST
    up, down = (np.full(n + 1, base, U64) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


class Words:
    """The words of several texts, in order.

    ``parting`` has True for each byte that parts words, the line feed among them.
    ``data``: the bytes; ``first``, ``last``: where each word begins and ends in
    them; ``bounds``: the number of words before each text, and in all.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, parting: np.ndarray = _SPACE):
        self.data = b"\n".join([*texts, b""])
        codes = np.frombuffer(self.data, np.uint8)
        self.codes = _LOWER[codes] if lower else codes
        space = parting[self.codes]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edges = np.concatenate([[0], edges])
        self.first, self.last = edges[::2], edges[1::2]
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.bounds = np.searchsorted(self.first, starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, by prefix sums; long words are hashed one by one."""
        n = len(self.first)
        out = np.empty(n, U64)
        up, down = _powers()
        at = 0
        with np.errstate(over="ignore"):
            while at < n:
                begin = self.first[at]
                to = int(np.searchsorted(self.first, begin + _CHUNK))
                end = min(self.last[to - 1], self.first[to - 1] + _LONGEST)
                sums = _BYTES[self.codes[begin:end]]
                sums *= up[: end - begin]
                np.cumsum(sums, out=sums)
                first, last = self.first[at:to] - begin, np.minimum(self.last[at:to] - begin, end - begin)
                got = sums[last - 1]
                got[1:] -= sums[first[1:] - 1]
                got *= down[first]
                out[at:to] = got
                at = to
            out = mixed(out)
        for i in np.flatnonzero(self.last - self.first > _LONGEST).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.codes[self.first[i] : self.last[i]].tobytes())
        return out

    def windows(self, n: int) -> np.ndarray:
        """Of each run of ``n`` words, by its first word, whether it lies in one text."""
        inside = np.ones(max(0, len(self.first) - n + 1), bool)
        cut = (self.bounds[1:-1, None] - np.arange(1, n)).ravel()
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
        return inside


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Odd multiplier of the rolling sums over word hashes.
STEP = U64(0x9E3779B97F4A7C15)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, by doubling: log(n) vector passes."""
    if len(words) < n:
        return np.empty(0, U64)
    total, covered = None, 0
    power, width = words, 1
    mult = STEP
    left = n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if total is None:
                    total, covered = power, width
                else:
                    size = min(len(total), len(power) - covered)
                    shift = _power(STEP, covered)
                    total = total[:size] + power[covered : covered + size] * shift
                    covered += width
            left >>= 1
            if left:
                size = len(power) - width
                power = power[:size] + power[width : width + size] * mult
                width *= 2
                mult = mult * mult
        out = mixed(total[: len(words) - n + 1])
    return out


def _power(base: np.uint64, exponent: int) -> np.uint64:
    return U64(pow(int(base), exponent, 1 << 64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
