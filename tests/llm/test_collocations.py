"""Phrase collocations against brute force over every phrase of every piece."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, x bigint, y string, f int, phrase string, score double"


def rows_of(texts, langs):
    # Extra columns bear names that the operator uses itself.
    return [(i, t, g, 1, "y", 2, "p", 0.5) for i, (t, g) in enumerate(zip(texts, langs, strict=True))]


def some_texts():
    rng = random.Random(8)
    vocab = ["the", "The", "of", "New", "york", "CITY", "été", "É", "a", "b", "c", "d"]
    phrases = ["New York City", "in  spite\tof", "point-of view", "a b", "b a", "c c c"]
    glue = [" ", " ", " ", ". ", "\n", ", ", "\x0b", ";", "\r\n", " ", "\x1f"]
    out = []
    for _ in range(250):
        out.append("".join(rng.choice(vocab + phrases) + rng.choice(glue) for _ in range(rng.randint(0, 60))))
    return [*out, *out[:20], "x y z " * 3000, "lone words here", None, "", " .;\n", "New york" * 3]


def brute(texts, langs, least, covered, top):
    f, n = Counter(), Counter()
    for text, lang in zip(texts, langs, strict=True):
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows = defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in candidates.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in rows.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def collected(found):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


def langs_of(texts):
    return [["en", "en", "en", "fr", None, "und"][i % 6] for i in range(len(texts))]


@pytest.mark.parametrize(("least", "covered", "top"), [(10, 50, 2000), (2, 50, 12), (3, 90, 40)])
def test_mine(spark, least, covered, top):
    texts = some_texts()
    docs = spark.createDataFrame(rows_of(texts, langs_of(texts)), SCHEMA).repartition(5)
    want = brute(texts, langs_of(texts), least, covered, top)
    assert len(want) > 10
    assert collected(collocations.mine(docs, least, covered, top)) == want


def test_full_bitmap_and_one_hash_of_two_words(spark, monkeypatch):
    """The bitmap passes everything, and the first hashing takes several words for one."""
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)
    texts = some_texts()
    docs = spark.createDataFrame(rows_of(texts, langs_of(texts)), SCHEMA)
    scan, salts = collocations._scan, []

    def poor(docs, salt, found, schema):
        salts.append(salt)
        if salt:
            return scan(docs, salt, found, schema)

        def merged(p):
            p.hashes = p.hashes % np.uint64(7) + np.uint64(1)
            return found(p)

        return scan(docs, salt, merged, schema)

    monkeypatch.setattr(collocations, "_scan", poor)
    assert collected(collocations.mine(docs, 5, 50, 100)) == brute(texts, langs_of(texts), 5, 50, 100)
    assert salts == [0, 1, 1, 1]


def test_scores_are_exact(spark):
    big = [(10**15 - 1, 10**15 - 1, 10**15 - 1), (10**15 - 2, 10**15 - 1, 10**15 - 1), (123456789012345, 123456789012346, 999999999999999), (10, 11, 13)]
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(big)], "i int, a bigint, l bigint, r bigint").select("i", collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: 1_000_000 * a * a // (x * y) for i, (a, x, y) in enumerate(big)}


def test_nothing(spark):
    assert collected(collocations.mine(spark.createDataFrame([], SCHEMA))) == []
    assert collected(collocations.mine(spark.createDataFrame(rows_of([None, "", "a b"], [None, "en", "en"]), SCHEMA))) == []
