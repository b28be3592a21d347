"""Quality classifier by positive-unlabelled learning.

Trusted documents (label 1) are positives, documents without a label are the
unlabelled web text.  The classifier minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss.  The prior, the share of positives in web text, is
estimated from positives and unlabelled text alone: a classifier of the one
against the other is fitted on half of the sample, and on the other half the
prior is the least ratio of the shares of unlabelled and of positive documents
above a score, taken where its confidence bound is least (best bin estimation).
Labels other than 1 only keep their documents out of the sample.  Its inputs are
shape statistics of the text only: shares of kinds of characters, of repeated
words, lines and windows, and lengths, with their squares.

It is fitted on bounded, hash-chosen samples (``TRAIN_ROWS`` of each kind);
every document is then scored in one pass without a shuffle.  Null text is
scored as empty text.  Without positives or without unlabelled documents there
is nothing to learn from and every score is 0.5.  A doc_id that is labelled more
than once counts as positive if one of its labels is 1; rows without a doc_id
are unlabelled.  Rows that repeat a doc_id are scored one by one.  An empty
table gives an empty result.  Texts of any length are taken whole.  Of the columns
only doc_id, text, the labels' quality and those named by ``keep`` are read, whatever
the others are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.text import slices

#: About how many positives, and how many unlabelled documents, the fit uses.
TRAIN_ROWS = 8000
EPOCHS = 400
#: Chance that the confidence bound of the prior's ratio does not hold.
DOUBT = 0.1


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = np.stack(
    [
        _table(b"#*$%&|<>"),
        _table(b"!?"),
        _table(b"|"),
        _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _table(b"abcdefghijklmnopqrstuvwxyz"),
        _table(b"0123456789"),
        _table(b".,;:"),
        _table(b"\n"),
        _table(b"@/\\_=+~^{}[]()\"'`"),
        _table(bytes(range(0x80, 0x100))),
    ]
).astype(float)
N_FEATURES = 23


def features(raw: bytes) -> list[float]:
    """Shape statistics of one text."""
    n = len(raw)
    words = raw.split()
    k = len(words)
    if k == 0:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = _KINDS @ counts / n
    lengths = np.fromiter(map(len, words), np.int32, k)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / (k - 2) if k > 2 else 1.0
    upper = sum(map(bytes.isupper, words)) / k
    signs = sum(1 for w in words if w[-1:] in b"#*$%&|<>!") / k
    share = counts[counts > 0] / n
    return [
        *np.sqrt(kinds).tolist(),
        math.log1p(k) / 5,
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        float((lengths <= 3).mean()),
        math.log(distinct + 1) / math.log(k + 2),
        triples,
        1 - len(set(lines)) / len(lines),
        math.log1p(k / len(lines)) / 4,
        upper,
        signs,
        float(-(share * np.log2(share)).sum()) / 5,
        max(words.count(w) for w in set(words[:3])) / k,
        0.0,
    ]


def _feature_rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in slices(batch):
                rows = pa.array([features(r) for r in raws], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], rows], names=[*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, f"{types}, x array<double>")


class Model:
    """A linear score over standardised statistics and their squares."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.mean, self.std, self.weights, self.bias, self.prior = mean, std, weights, bias, prior

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.concatenate([z, z * z / 4], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        g = self.expand(x) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = EPOCHS, decay: float = 1e-3) -> Model:
    """Full-batch Adam on the non-negative risk; where the negative part is below 0, its gradient is undone.

    Without a prior the risk is that of telling positive from unlabelled rows, both kinds weighing the same.
    """
    both = np.concatenate([positive, unlabelled])
    share = 0.5 if prior is None else prior
    model = Model(both.mean(axis=0), np.maximum(both.std(axis=0), 1e-2), np.zeros(2 * both.shape[1]), 0.0, share)
    p, u = model.expand(positive), model.expand(unlabelled)
    w, b = model.weights, math.log(share / (1 - share))
    m = v = np.zeros(len(w) + 1)
    for t in range(1, epochs + 1):
        gp, gu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -50, 50))), 1 / (1 + np.exp(-np.clip(gu, -50, 50)))
        # Logistic losses: against label 1 log(1 + exp(-g)), against label 0 log(1 + exp(g)).
        grad_pos = np.append(-(p * (1 - sp)[:, None]).mean(axis=0), -(1 - sp).mean()) * share
        grad_neg = np.append((u * su[:, None]).mean(axis=0), su.mean())
        if prior is None:
            grad = grad_pos + (1 - share) * grad_neg
        else:
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            grad_neg = grad_neg - prior * np.append((p * sp[:, None]).mean(axis=0), sp.mean())
            grad = grad_pos + grad_neg if negative >= 0 else -grad_neg
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(model.mean, model.std, w, float(b), share)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows, from scores of a classifier of positive against unlabelled rows.

    Above any score lies at least that share of the unlabelled rows, times the
    share of positives above it; the ratio is least where other rows are rare.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.concatenate([[-np.inf], p])
    above_p = 1 - np.searchsorted(p, at) / len(p)
    above_u = 1 - np.searchsorted(u, at) / len(u)
    slack = math.sqrt(math.log(4 / DOUBT) / (2 * len(u))) + math.sqrt(math.log(4 / DOUBT) / (2 * len(p)))
    some = above_p > 0
    best = int(np.argmin(np.where(some, (above_u + slack) / np.where(some, above_p, 1), np.inf)))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on documents with label 1 and documents without a label."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_doc")).agg(F.max("quality").alias("quality"))
    n1 = known.where("quality = 1").count()
    texts = docs.select("doc_id", "text")
    free = texts.join(known, F.col("doc_id") == F.col("l_doc"), "left_anti")
    n_free = free.select("doc_id").count()
    # A row's lot depends on its text too, so that rows without an id do not share one.
    lot = F.xxhash64("doc_id", "text", F.lit(29))
    place = F.pmod(lot, F.lit(1_000_000)) / 1_000_000
    good = texts.join(known.where("quality = 1"), F.col("doc_id") == F.col("l_doc")).where(place < rows / max(1, n1))
    sample = good.select(F.lit(1).alias("kind"), lot.alias("lot"), "text").unionByName(free.where(place < rows / max(1, n_free)).select(F.lit(0).alias("kind"), lot.alias("lot"), "text"))
    # By kind and lot: the fit sees the rows in one order, whatever the tasks did.  Copies share a lot and may be many: the limit bounds them.
    got = _feature_rows(sample, ("kind", "lot")).orderBy("lot", "kind").limit(3 * rows).toPandas()
    x, kind = np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES), got["kind"].to_numpy()
    positive, unlabelled = x[kind == 1], x[kind == 0]
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(2 * N_FEATURES), 0.0, 0.5)
    against = fit(positive[::2], unlabelled[::2], None)
    return fit(positive, unlabelled, estimate_prior(against.score(positive[1::2]), against.score(unlabelled[1::2])))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score, predicted."""
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inputs = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in slices(batch):
                got = shared.value.score(np.array([features(r) for r in raws], float))
                arrays = [*[part.column(i) for i in range(len(keep))], pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "score", "predicted"])

    return inputs.mapInArrow(run, f"{types}, score double, predicted int")
