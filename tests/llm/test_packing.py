"""Packing against the tokenizers library and a count of what every sequence holds."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from signalweave.llm import packing
from signalweave.llm.bpe import ByteEncoder, byte_encoder, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, start string, ids int, part string, k0 int, _text int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows_of(texts, ids=None):
    # Extra columns bear names that the operator uses itself.
    return [(i, t, "s", 1, "p", 2, 3) for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)]


def odd_texts():
    rng = random.Random(11)
    signs = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", " ", " ", "3", "³", "漢", "，", "<|endoftext|>", "<|", "—", "“", "\r\n", "\x1c", "\x85", "😀", "\x00", "word ", "The ", ".\n"]
    plain = [" ".join(rng.choices(["the", "Règle", "of", "x1", "don't", "stone,", "end.\nNext"], k=rng.randint(1, 900))) for _ in range(60)]
    return [*["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(200)], *plain, "y" * 3000, " z" * 9000, "one", "one", None, "", "\n", " "]


def check(found, want, size):
    """Every id of every document lies in one piece, sequences have no gap and no more than ``size`` ids."""
    inside, of_doc = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) // 4 > 0
        inside[r.sequence_id].append((r.offset, r.length))
        of_doc[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    got = Counter()
    for (doc, total), pieces in of_doc.items():
        parts = defaultdict(list)
        for start, ids in pieces:
            parts[start].append(ids)
        copies = len(parts[0])
        if copies == 1:
            whole = [x for _, ids in sorted(pieces) for x in ids]
            assert len(whole) == total
            got[doc, tuple(whole)] += 1
        else:  # rows alike but for their cuts
            got[doc, None] += copies
    assert got == want
    lengths = [sum(n for _, n in pieces) for pieces in inside.values()]
    return sum(size - n for n in lengths if n & (n - 1))


@pytest.mark.parametrize(("size", "windows", "slack", "parts"), [(1024, 64, 4, 3), (16, 2, 0, 5), (8, 1, 3, 1), (64, 4, 5, 7)])
def test_pack(spark, library, monkeypatch, size, windows, slack, parts):
    monkeypatch.setattr(packing, "FAN", 2)  # several rounds of merging
    texts = odd_texts()
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(parts)
    found = packing.pack(docs, size=size, end=0, windows=windows, slack=slack)
    want = Counter((i, (*library.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in enumerate(texts))
    padding = check(found.collect(), want, size)
    assert padding <= slack * sum(len(k[1]) for k in want) / (size - slack)


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame(rows_of(["same text", "same text", "other", None, "x"], [7, 7, 7, None, None]), SCHEMA).repartition(2)
    found = packing.pack(docs).collect()
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
    assert Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0) == Counter({(7, 3): 2, (7, 2): 1, (None, 1): 1, (None, 2): 1})


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none).collect() == []
    assert packing.sequences(packing.pack(none)).collect() == []
    one = packing.pack(spark.createDataFrame(rows_of([None]), SCHEMA)).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset, r.ids) for r in one] == [(0, 0, 1, 1, 0, bytes(4))]


def test_sequences(spark):
    docs = spark.createDataFrame(rows_of(odd_texts()), SCHEMA)
    pieces = packing.pack(docs, size=64, windows=3, slack=9)
    joined = defaultdict(bytes)
    for r in sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset)):
        joined[r.sequence_id] += bytes(r.ids)
    for r in packing.sequences(pieces, size=64, pad=5).collect():
        n = len(joined[r.sequence_id]) // 4
        assert r.n_tokens == n
        assert bytes(r.ids) == joined[r.sequence_id] + (b"\x05\0\0\0" * (64 - n) if n & (n - 1) else b"")


def test_kept_columns_and_sizes_are_checked(spark):
    docs = spark.createDataFrame(rows_of(["a"]), SCHEMA)
    with pytest.raises(ValueError):
        packing.pack(docs, keep=("doc_id", "start"))
    with pytest.raises(ValueError):
        packing.pack(docs, size=1000)


def test_encoder_forgets_and_meets_one_hash_twice(library, monkeypatch):
    texts = [t or "" for t in odd_texts()]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    small = ByteEncoder(PATH, memory=2000)
    for k in range(0, len(texts), 50):
        assert [x.tolist() for x in small.encode([t.encode() for t in texts[k : k + 50]])] == want[k : k + 50]
    # All words alike by hash: bytes tell them apart.
    from signalweave.llm import bpe

    monkeypatch.setattr(bpe, "mixed", lambda x: x * np.uint64(0) + np.uint64(1))
    assert [x.tolist() for x in ByteEncoder(PATH).encode([t.encode() for t in texts])] == want


def test_long_text(library):
    text = " ".join(f"w{i % 5003}" for i in range(1_000_000))
    got = byte_encoder(PATH).encode([text.encode()])[0]
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids
