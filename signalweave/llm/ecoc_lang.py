"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier over
hashed letter pairs and triples tells the languages with 1 from those with 0:
its weights are log-odds of the n-grams on the two sides, from counts over a
bounded sample of labelled documents.  Decoding takes the codeword with the
least weighted exponential loss, a bit weighing the more for a language the
more surely that language's own text answers it.  Where the second codeword is
almost as near, the document is flagged ambiguous.

Language, source and doc_id are never inputs.  Null text and text without a
letter give ``und`` with score 0.  Without any labelled document everything is
``und``, and an empty table gives an empty result.  Rows that repeat a doc_id, or
have none, are documents of their own, for learning and for prediction.  Texts of
any length are taken whole; a task holds the largest a few times.  Of the columns
only text, those named by ``keep`` and, for learning, doc_id and lang are read,
whatever the others are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweave.llm.store import sent
from signalweave.llm.text import slices

BUCKET_BITS = 14
#: About how many documents of each language the classifiers learn from.
TRAIN_ROWS = 4000
#: Tasks that count n-grams of the sample.
TRAIN_TASKS = 12
AMBIGUOUS = 0.2
SMOOTHING = 0.5

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all letter pairs and triples of some texts, the first of each text, counts, and whether it has letters.

    Runs of other characters count as one space.
    """
    texts = [f" {r.decode('utf-8', 'replace').lower()} " for r in raws]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    letter = _letter_table()[points]
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])
    points, letter, owner = points[keep].astype(np.uint32), letter[keep], owner[keep]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    size = np.uint32(1 << BUCKET_BITS)
    with np.errstate(over="ignore"):
        pair = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)
        triple = pair[:-1] * np.uint32(0xC2B2AE3D) + points[2:] * np.uint32(0x27D4EB2F)
        pair, triple = (pair ^ (pair >> np.uint32(15))) * np.uint32(0x2C1B3C6D), (triple ^ (triple >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    pair, triple = (pair >> np.uint32(32 - BUCKET_BITS)), (triple >> np.uint32(32 - BUCKET_BITS)) + size
    same2, same3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    pair, triple, o2, o3 = pair[same2], triple[same3], owner[:-1][same2], owner[:-2][same3]
    n2, n3 = np.bincount(o2, minlength=len(texts)), np.bincount(o3, minlength=len(texts))
    return pair, triple, np.stack([n2, n3]), has


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: all distinct splits up to six languages, else the best of random dense codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        cols = [[1 if i == 0 or (k >> (i - 1)) & 1 else -1 for i in range(n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), math.ceil(10 * math.log2(n))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = int(((bits - code @ code.T) / 2 + bits * np.eye(n)).min())
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return best


class Model:
    """Weights (2 * buckets, bits), codewords, loss weights, languages."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = code_matrix(len(self.langs))
        half = 1 << BUCKET_BITS
        rates = []
        for lang in self.langs:
            c = counts[lang].astype(float) + SMOOTHING
            c[:half] /= c[:half].sum()
            c[half:] /= c[half:].sum()
            rates.append(c)
        p = np.array(rates).reshape(len(self.langs), 2 * half)
        weights = []
        for b in range(self.code.shape[1]):
            ones, zeros = p[self.code[:, b] > 0], p[self.code[:, b] < 0]
            weights.append(np.log(ones.mean(axis=0) / zeros.mean(axis=0)) if len(ones) and len(zeros) else np.zeros(2 * half))
        self.weights = np.array(weights, np.float32).T.copy()
        # What a text of the language answers to each bit on average, as a share of the whole.
        own = (p @ self.weights) * self.code / 2 if self.langs else np.ones((0, 1))
        sure = np.maximum(own, 1e-3)
        self.loss_weights = sure / sure.sum(axis=1, keepdims=True)
        self.scale = float(1 / max(np.median(sure), 1e-6)) if self.langs else 1.0

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score 0 to 1, ambiguous."""
        loss = (np.exp(np.clip(-margins[:, None, :] * self.scale * self.code[None], -30, 30)) * self.loss_weights[None]).sum(axis=2)
        best = loss.argmin(axis=1)
        if len(self.langs) == 1:
            return best, np.ones(len(best)), np.zeros(len(best), bool)
        low = np.sort(loss, axis=1)
        score = 1 - low[:, 0] / np.maximum(low[:, 1], 1e-12)
        return best, np.clip(score, 0, 1), score < AMBIGUOUS


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from about ``rows`` documents of each language, chosen by hash of doc_id and text; ``labelled``: doc_id, text, lang."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("_n"))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    # The counts, a row for each language, go to the texts: only the sample travels.
    sample = known.join(sent(sizes), "lang").where(place < share).select("lang", "text").repartition(TRAIN_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 << BUCKET_BITS
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, raws in slices(batch):
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in set(langs.tolist()):
                    pair, triple, _, _ = grams_of([r for r, x in zip(raws, langs, strict=True) if x == lang])
                    held.setdefault(lang, np.zeros(size, np.int64))
                    held[lang] += np.bincount(pair, minlength=size) + np.bincount(triple, minlength=size)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([c.tobytes() for c in held.values()], pa.binary())], names=["lang", "counts"])

    def total(part: pd.DataFrame) -> pd.DataFrame:
        out = sum(np.frombuffer(raw, np.int64) for raw in part["counts"])
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "counts": [out.tobytes()]})

    partial = sample.mapInArrow(count, "lang string, counts binary")
    got = partial.groupBy("lang").applyInPandas(total, "lang string, counts binary").collect()
    return Model({r["lang"]: np.frombuffer(r["counts"], np.int64) for r in got})


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score, ambiguous; one pass without a shuffle."""
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, raws in slices(batch, limit=1 << 20):
                pair, triple, counts, has = grams_of(raws)
                margins = np.zeros((len(raws), m.weights.shape[1]))
                for grams, n in ((pair, counts[0]), (triple, counts[1])):
                    some = np.flatnonzero(n)
                    if len(some):
                        first = np.concatenate([[0], np.cumsum(n)[:-1]])[some]
                        sums = np.add.reduceat(m.weights.take(grams, axis=0), first, axis=0)
                        margins[some] += sums / n[some, None] / 2
                if m.langs:
                    best, score, unsure = m.decode(margins)
                    langs = [m.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
                else:
                    langs, score, unsure = ["und"] * len(raws), np.zeros(len(raws)), np.ones(len(raws), bool)
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(langs, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(unsure | ~has)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score", "ambiguous"])

    return docs.select(*keep, "text").mapInArrow(run, f"{types}, lang_pred string, score double, ambiguous boolean")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
