"""The ten operators against brute force on small tables with nulls, ties, copies and odd texts."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalweave.llm import chunk_bpe, ecoc_lang, entropy_mix, extendible, mcd_rules, ngram_join, pu_quality, spotsigs, superkmer, wavelet
from signalweave.llm.bpe import BatchEncoder, WordEncoder, tokenizer_path
from signalweave.llm.text import Words, gram_hashes, sliding_min

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    # Extra columns bear names that the operators use themselves.
    return [(i, t, ["en", "fr", None][k % 3], ["a", "b", None][k % 3], None if t is None else len(t), 0.5, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


def odd_texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(60, 200))) for _ in range(12)]
    near = [b.replace("w1 ", "w2 ", 1) + " tail" for b in base[:6]]
    passage = " ".join(rng.choices(vocab, k=70))
    shared = [f"{b} {passage} {c}" for b, c in zip(base[6:9], base[9:12], strict=True)]
    return [*base, *base[:4], *near, *shared, None, "", "  \t\n ", "one", "one", "two words", "Three little words", "three LITTLE words", "x " * 5000, "a b c d e", "É é z w" * 30]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(odd_texts()), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_classes(texts, n, percent):
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_classes(docs, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs, n, percent).collect()}
    assert got == brute_classes(odd_texts(), n, percent)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (2, 40)])
def test_jaccard_links_are_all_links(spark, n, percent):
    texts, ids = odd_texts(), [None if i % 5 == 0 else i // 2 for i in range(len(odd_texts()))]
    links, members = ngram_join.jaccard_links(spark.createDataFrame(rows_of(texts, ids), SCHEMA), n, percent)
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)
    want = Counter((str(d), len(s), sum(near(s, t) for t in sets) - bool(s)) for d, s in zip(ids, sets, strict=True))
    got = members.collect()
    assert Counter((str(r.doc_id), r.n_shingles, r.n_links) for r in got) == want
    different = list({s for s in sets if s})
    pairs = sum(near(a, b) for i, a in enumerate(different) for b in different[:i])
    found = [tuple(r) for r in links.collect()]
    assert len(found) == len({tuple(sorted(p)) for p in found}) == pairs > 3
    assert {x for p in found for x in p} <= {r.name for r in got}


def test_jaccard_classes_of_many_near_copies(spark):
    rng = random.Random(2)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for _ in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"u{rng.randrange(50)}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(frame, 4, 85).collect()}
    assert got == brute_classes(texts, 4, 85)


def test_list_pairs_keeps_all_that_may_link():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(2, 300))
        size = np.sort(rng.integers(1, 400, n)).astype(np.int32)
        pos = np.minimum(rng.integers(0, 60, n), size - 1).astype(np.int32)
        label = rng.integers(0, 4, n)
        got = set(zip(*[x.tolist() for x in ngram_join.list_pairs(size, pos, label, 85)], strict=True))
        want = set()
        for j in range(n):
            for i in range(j):
                a, b = int(size[i]), int(size[j])
                room = 1 + min(a - pos[i] - 1, b - pos[j] - 1) + min(pos[i], pos[j])
                if label[i] != label[j] and 100 * a >= 85 * b and room >= -(-85 * (a + b) // 185):
                    want.add((i, j))
        assert got == want


def test_pairs_between_classes_are_told_once_a_task_and_by_their_first_shingle(spark):
    # Two classes of 40 sets that share 100 shingles of 160, too few to link: their first common shingle stands too late.
    rows, order = [], {}
    for k in range(80):
        own = [f"{k % 2}-{i}" for i in range(58)] + [f"{k}-{i}" for i in range(2)]
        shared = [f"s{i}" for i in range(100)]
        order[k] = own + shared
    number = {t: i for i, t in enumerate(sorted({t for o in order.values() for t in o}, key=lambda t: (t[0] == "s", t)))}
    for k, tokens in order.items():
        placed = sorted(number[t] for t in tokens)
        rows += [(t, k, 160, p, k % 2, 0, 0, 0, 0) for p, t in enumerate(placed[: 160 - 128 + 60])]
    lists = spark.createDataFrame(rows, "token bigint, f1 bigint, size int, pos int, label bigint, h0 bigint, h1 bigint, h2 bigint, h3 bigint")
    assert ngram_join._cross_pairs(lists, 80).count() == 0
    # Sets of two classes that begin alike: the first of their common shingles tells the pair.
    near = [(t, f1, 100, t, f1, 0, 0, 0, 0) for f1 in (1, 2) for t in range(21)]
    assert [tuple(r) for r in ngram_join._cross_pairs(spark.createDataFrame(near, lists.schema), 80).collect()] == [(1, 2)]


def test_remembered_words_of_the_chunk_encoder_are_few():
    coder = chunk_bpe._encoder(tokenizer_path())
    assert 2 * coder.words.words.limit + 2 * coder.words.pieces.limit + chunk_bpe.CHUNK_MEMORY <= 70 << 20


def test_shared_first_keeps_every_pair_that_links():
    rng = np.random.default_rng(4)
    linked = 0
    for _ in range(3000):
        percent, base = int(rng.integers(40, 96)), rng.permutation(200)[: rng.integers(1, 60)]
        a = np.unique(np.concatenate([base, rng.integers(0, 200, rng.integers(0, 6))]))
        b = np.unique(np.concatenate([base, rng.integers(0, 200, rng.integers(0, 6))]))
        common = np.intersect1d(a, b)
        if 100 * len(common) >= percent * (len(a) + len(b) - len(common)):
            linked += 1
            at = [np.array([np.searchsorted(x, common[0])]) for x in (a, b)]
            assert all(p[0] <= len(x) - ngram_join.min_overlap(len(x), percent) for p, x in zip(at, (a, b), strict=True))
            assert ngram_join.shared_first(np.array([len(a)]), at[0], np.array([len(b)]), at[1], percent).all()
    assert linked > 500


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TRICKY = ["Don't we'LL <|endoftext|>x <|startoftext|>", "İstanbul ΣΑΣ ﬁ ９ ½ ª 日本語  x　y \x00\x01 it's 'RE a1b2_c-d", "café " * 300, "x" * 3000, "naïve²³ 😀😀!!" * 30, "É́ é ́z"]


def test_wavelet_shards_round_trip(spark):
    texts = [*odd_texts(), *TRICKY]
    path = wavelet.write_token_shards(spark.createDataFrame(rows_of(texts), SCHEMA), shard_tokens=700)
    got = sorted(wavelet.read_token_shards(spark, path).collect(), key=lambda r: r.doc_id)
    lib, at = library(), 0
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stored_shards_answer_counts_places_and_access(spark, empty):
    texts = [*odd_texts(), "one one one"]
    path = wavelet.write_token_shards(spark.createDataFrame(rows_of(texts), SCHEMA), shard_tokens=500)
    lib = library()
    stream = [i for t in texts for i in [*lib.encode(t or "", add_special_tokens=False).ids, 2]]
    asked = [2, stream[0], stream[-2], 49000]
    counts = Counter(stream)
    assert {r.token: r.n for r in wavelet.token_counts(spark, path, asked).collect()} == {t: counts[t] for t in asked}
    want = [(t, i) for i, t in enumerate(stream) if t in asked]
    assert Counter((r.token, r.place) for r in wavelet.token_places(spark, path, asked).collect()) == Counter(want)
    places = [0, 1, 499, 500, 501, len(stream) // 2, len(stream) - 1, len(stream), -1]
    assert {r.place: r.token for r in wavelet.tokens_at(spark, path, places).collect()} == {i: stream[i] for i in places if 0 <= i < len(stream)}
    none = wavelet.write_token_shards(empty)
    assert wavelet.read_token_shards(spark, none).collect() == [] and wavelet.token_places(spark, none, [2]).collect() == []
    assert [r.n for r in wavelet.token_counts(spark, none, [2]).collect()] == [0] and wavelet.tokens_at(spark, none, []).collect() == []


def test_only_words_not_lately_remembered_are_looked_at_one_by_one(monkeypatch):
    coder, asked = WordEncoder(tokenizer_path()), []
    known = " ".join(f"word{i}" for i in range(200)).encode()
    first = coder.encode(known)
    find, cut = coder._word, coder._cut
    pieces = []
    monkeypatch.setattr(coder, "_word", lambda w: asked.append(w) or find(w))
    monkeypatch.setattr(coder, "_cut", lambda p: pieces.append(p) or cut(p))
    coder.pieces.put = lambda *a: pytest.fail("a word of one piece is remembered as a word")
    raw = b"New " + known + b" new New"
    want = library().encode(raw.decode(), add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(raw), "<u2").tolist() == want and first in coder.encode(raw)
    assert asked == [b"New", b"new"] and pieces == ["new", "new"]


def test_each_distinct_word_of_a_batch_is_encoded_once(monkeypatch):
    coder, asked, given = BatchEncoder(tokenizer_path()), [], []
    one, ranked = coder.words._word, coder.ranked
    monkeypatch.setattr(coder.words, "_word", lambda w: asked.append(w) or one(w))
    monkeypatch.setattr(coder, "ranked", type("", (), {"encode_to_numpy": lambda _, t, **k: given.append(t) or ranked.encode_to_numpy(t, **k)})())
    texts = [" New words&& ", None, "", "\n", "don't 日本語 New", *["words&& New Ünïque 日本語\fx1y22"] * 50]
    ids, bounds = coder.encode(pa.array(["left out", *texts])[1:])
    want = [library().encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want and bounds[0] == 0
    assert given == ["new\nwords\n&&\nünïque\nx\n1\ny\n2\n2\n"] and sorted(asked) == sorted([b"", b"don't", "日本語".encode()])
    for nothing in ([], [None], ["", " \t"]):
        ids, bounds = coder.encode(pa.array(nothing, pa.large_string()))
        assert len(ids) == 0 and bounds.tolist() == [0] * (len(nothing) + 1)


def test_batches_are_encoded_as_by_the_library():
    rng, lib, coder = random.Random(8), library(), BatchEncoder(tokenizer_path())
    signs = [chr(c) for c in [*range(256), *range(0x100, 0x138), 0x17F, 0x212A, 0x301, 0x4E00, 0x2003, 0x1F600]]
    vocabulary = [k.replace("</w>", rng.choice(["", " "])) for k in rng.sample(sorted(lib.get_vocab()), 6000) if k.replace("</w>", "").isascii()]
    texts = [*odd_texts(), *TRICKY, "".join(vocabulary), "y" * 255 + " " + "y" * 256, "\x1c \x1d\x1e\x1f\x85\xa0a", "it'S 's x's ''s <| <|EndOfText|>|>", "aaaaa aaaaaaaa bababab 0007"]
    texts += ["".join(rng.choices([*"abcdefgth"] * 4 + [" "] * 9 + signs, k=300)) for _ in range(150)]
    texts += [f"{a}{b} x{a}{b}y" for a in signs[:0x130] for b in "a1!'é \n"]
    ids, bounds = coder.encode(pa.array(texts))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == lib.encode(t or "", add_special_tokens=False).ids, t
    cut = [b"\xc3", b"a\xc3 \xa9", b"\xc3\xc3\xa9", b"\xc4\xb0 \xc4\xaf\xaf", b"\xe9t\xe9"]
    ids, bounds = coder.encode(pa.Array.from_buffers(pa.string(), len(cut), pa.array(cut).buffers()))
    assert [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [coder.words.encode(t) for t in cut]


def test_every_token_of_the_vocabulary_is_reached_by_its_merges():
    """Then no two tokens that make a third when joined meet but by that third's own merge, and any encoder by ranks gives the ids of one by merges."""
    read = json.loads(open(tokenizer_path(), encoding="utf-8").read())["model"]
    rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(read["merges"])}
    for token in read["vocab"]:
        parts = list(token.removesuffix("</w>"))
        if token.endswith("</w>"):
            parts[-1:] = [parts[-1] + "</w>"]
        while len(parts) > 1:
            pairs = [(rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(pairs)
            assert best < len(rank), token
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [token]


def test_vocabularies_of_another_kind_are_refused():
    with pytest.raises(ValueError, match="not a vocabulary of words"):
        BatchEncoder(tokenizer_path("byte_bpe_50k.json"))


def test_shards_end_with_the_document_that_fills_them(spark):
    texts = ["a b c", None, "d e f g", "x " * 40, "", "a", "b c"]
    path = wavelet.write_token_shards(spark.createDataFrame(rows_of(texts), SCHEMA).coalesce(1), shard_tokens=9)
    spans = spark.read.parquet(f"{path}/manifest").orderBy("part", "seq").collect()
    begins = list(np.cumsum([0, 4, 1, 5, 41, 1, 2, 3]))
    assert [r.start for r in spans] == list(np.cumsum([0, *[r.n_tokens for r in spans[:-1]]])) and sum(r.n_tokens for r in spans) == begins[-1]
    assert all(r.start in begins for r in spans)
    for r in spans:  # but for its last document no shard is full
        inside = [b for b in begins if r.start < b < r.start + r.n_tokens]
        assert not inside or inside[-1] - r.start < 9


def test_steps_hold_all_rows_in_order():
    texts = [None, "", "abc", "d" * 25, "", "e" * 4, "f" * 9, None, "gh"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["doc_id", "text"])
    for limit in (1, 5, 10, 1000):
        steps = list(wavelet._steps(batch, limit))
        assert [x for s in steps for x in s.column(1).to_pylist()] == texts and all(s.num_rows for s in steps)
        assert all(sum(len(t or "") for t in s.column(1).to_pylist()[1:]) <= limit for s in steps)
    assert list(wavelet._steps(batch.slice(0, 0), 5)) == []


def test_wavelet_matrix_bytes_are_those_of_a_plain_build():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, 49408, n).astype(np.uint16)
        m, cur = wavelet.WaveletMatrix.build(ids), ids.tolist()
        for level in range(16):
            bits = [x >> (15 - level) & 1 for x in cur]
            assert np.unpackbits(m.planes[level], count=n).tolist() == bits and m.zeros[level] == n - sum(bits)
            assert m.ranks[level].tolist() == [sum(bits[: 512 * k]) for k in range(-(-max(n, 1) // 512) + 1)]
            cur = [x for x, b in zip(cur, bits, strict=True) if not b] + [x for x, b in zip(cur, bits, strict=True) if b]


def test_wavelet_matrix_queries():
    rng = np.random.default_rng(1)
    for n in (1, 7, 512, 513, 5000):
        ids = rng.integers(0, 49408, n).astype(np.uint16)
        ids[rng.random(n) < 0.4] = 2
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert (m.extract() == ids).all()
        for i in rng.integers(0, n, 20).tolist():
            assert m.access(i) == ids[i]
            assert m.rank(2, i) == (ids[:i] == 2).sum()
            assert m.select(int(ids[i]), int((ids[:i] == ids[i]).sum())) == i
        assert m.occurrences(2) == np.flatnonzero(ids == 2).tolist()
        assert m.count(2, n // 3, n) == (ids[n // 3 :] == 2).sum()
        with pytest.raises(IndexError):
            m.access(n)


def test_sharding_fits_and_splits_only_where_needed(spark):
    texts = [("ab" * (i % 37 + 1)) if i % 11 else None for i in range(500)]
    frame = spark.createDataFrame(rows_of([*texts, "z" * 900, "q" * 50, "q" * 50], [*range(500), 7000, 8000, 8000]), SCHEMA)
    got = extendible.assign_shards(frame, 400).collect()
    assert len(got) == 503
    sums, members = Counter(), defaultdict(set)
    for r in got:
        sums[r.shard] += r.n_bytes
        members[r.shard].add(r.doc_id)
        assert len(r.shard) == r.depth
    for r in got:
        assert r.shard_bytes == sums[r.shard]
        assert r.oversized == (r.shard_bytes > 400)
        assert not r.oversized or len(members[r.shard]) == 1
    shards = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))
    total = Counter()
    for shard, n in sums.items():
        for d in range(len(shard)):
            total[shard[:d]] += n
    assert all(n > 400 for n in total.values())  # every split bucket was too large


def test_written_shards_hold_every_document_once(spark, tmp_path):
    texts = ["ab" * (i % 23) for i in range(120)]
    docs = spark.createDataFrame(rows_of([*texts, "x", "y"], [*range(120), None, None]), SCHEMA).withColumn("shard", F.lit(5)).withColumn("hash", F.lit(1))
    path = f"file://{tmp_path}/shards"
    shards = {r.doc_id: r.shard for r in extendible.write_shards(docs, path, 300).collect()}
    back = spark.read.option("basePath", path).schema(spark.read.parquet(path).drop("shard").schema.add("shard", "string")).parquet(path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(zip([*range(120), None, None], [*texts, "x", "y"], strict=True))
    assert all((r.shard or "") == shards[r.doc_id] and r.own_shard == 5 and r.hash == 1 for r in back)
    assert len(set(shards.values())) > 4


def test_chunk_encoding_equals_the_library(spark):
    texts = [*odd_texts(), *TRICKY, " ".join(TRICKY * 20)]
    got = {r.doc_id: r for r in chunk_bpe.encode_texts(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    lib = library()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids
        assert got[i].decoded == decoded
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_chunks_of_shared_passages_are_reused():
    from signalweave.llm.bpe import encoder

    rng = random.Random(9)
    passage = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000))
    coder = chunk_bpe.ChunkEncoder(encoder(tokenizer_path()))
    for lead in ("one ", "quite another beginning "):
        raw = (lead + passage).encode()
        coder.encode(raw, chunk_bpe.chunk_ends(np.frombuffer(raw, np.uint8)).tolist())
    assert coder.reused > 20


def test_positive_unlabelled_quality(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    fold = F.pmod(ecoc_lang.crc_of_id(F.col("doc_id")), F.lit(3))
    model = pu_quality.train(docs.where(fold != 1), labels.where(fold != 1))
    got = pu_quality.score(docs, model).join(labels, "doc_id").where(fold == 1).toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    again = pu_quality.train(docs.where(fold != 1), labels.where(fold != 1))
    assert np.allclose(model.weights, again.weights)


def test_quality_scores_odd_and_empty_tables(docs, empty, spark):
    model = pu_quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    got = pu_quality.score(docs, model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert pu_quality.score(empty, model).count() == 0


def test_fingerprints_with_next(spark):
    texts = odd_texts()
    ids = [3 * i - 20 for i in range(len(texts))]
    got = {r.doc_id: r for r in spotsigs.with_next(spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(5)).collect()}
    plain = [t or "" for t in texts]
    assert len(got) == len(texts)
    for k, i in enumerate(ids):
        after = plain[(k + 1) % len(plain)]
        edited = spotsigs.edit(plain[k], after)
        own, changed, other = spotsigs.signatures(plain[k]), spotsigs.signatures(edited), spotsigs.signatures(after)
        r = got[i]
        assert r.n_chars == len(plain[k])
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (spotsigs.shown(own), spotsigs.shown(changed))
        assert r.near_edited == spotsigs.jaccard(own, changed)
        assert r.near_next == spotsigs.jaccard(own, other)


def plain_prints(text):
    """Spot signatures and plain chains as tuples of words, by their definition."""
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return {(text,)} if text else set()
    found = {("chain", *words[i : i + 3]) for i in range(len(words))}
    for i, w in enumerate(words):
        content = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
        if w in spotsigs.ANCHORS and len(content) == 2:
            found.add(("spot", w, *content))
    return found


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_fingerprint_likeness_by_definition(spark, small, ranges):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).collect()
    texts = [r.text or "" for r in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {r.doc_id: r for r in spotsigs.with_next(spark.createDataFrame(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for k, row in enumerate(rows):
        own, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(own) // 4
        a, b, c = plain_prints(own), plain_prints(own[: len(own) - cut] + after[:cut]), plain_prints(after)
        r = got[row.doc_id]
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)


def test_fingerprint_pairs_are_those_of_brute_force(docs):
    sigs = {i: frozenset(spotsigs.signatures(t or "").tolist()) for i, t in enumerate(odd_texts())}
    names = {}
    for i in sorted(sigs):
        names.setdefault(sigs[i], i)
    sets = [(i, s) for s, i in names.items() if s]
    want = {tuple(sorted((i, j))) for i, a in sets for j, b in sets if i < j and len(a & b) >= 0.8 * len(a | b)}
    assert {tuple(sorted((r.a, r.b))) for r in spotsigs.similar_pairs(docs, 0.8).collect()} == want


def test_fingerprint_pairs_of_rows_without_an_id(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    one, two = (" ".join(rng.choices(vocab, k=200)) for _ in range(2))
    rows = rows_of([one, one + " end", two, two + " end", two + " end"], [5, None, None, None, None])
    got = [(r.a, r.b, r.n_class_a, r.n_class_b) for r in spotsigs.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.8).collect()]
    assert Counter(got) == Counter([(5, None, 1, 1), (None, None, 1, 2)])


def test_fingerprints_are_of_one_kind_for_short_and_long_texts(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(5, 11):  # k anchors with two content words after each: signatures on both sides of 8
        for _ in range(5):
            words = rng.choices(vocab, k=90)
            for at in range(k):
                words[9 * at] = "the"
            texts += [" ".join(words), " ".join(["the", *words[1:], "the", "w1", "w2"])]
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        assert spotsigs.jaccard(spotsigs.signatures(a), spotsigs.signatures(b)) > 0.8
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in spotsigs.similar_pairs(spark.createDataFrame(rows_of(texts), SCHEMA), 0.8).collect()}
    assert found == {(i, i + 1) for i in range(0, len(texts), 2)}


def test_language_codes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    fold = F.pmod(ecoc_lang.crc_of_id(F.col("doc_id")), F.lit(5))
    model = ecoc_lang.train(docs.where(fold != 0))
    got = ecoc_lang.predict(docs, model, keep=("doc_id", "lang")).where(fold == 0).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_of_texts_without_letters(docs, empty):
    got = {r.doc_id: r for r in ecoc_lang.predict(docs, ecoc_lang.train(docs)).collect()}
    texts = odd_texts()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i] or "")) for i, r in got.items())
    assert {r.lang_pred for r in ecoc_lang.predict(docs, ecoc_lang.train(empty)).collect()} == {"und"}
    assert ecoc_lang.predict(empty, ecoc_lang.train(empty)).count() == 0


@pytest.mark.parametrize("n", [2, 4, 9])
def test_codewords_differ(n):
    code = ecoc_lang.code_matrix(n)
    assert len({tuple(row) for row in code.tolist()}) == n
    assert (np.abs(code.sum(axis=0)) < n).all()


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, rest, out = share * sum(sizes.values()), set(names), {}
    while rest:
        unit = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in rest}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            rest.remove(s)
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), "en", rng.choice(["a"] * 8 + ["b", "c", "d", None]), 0, 0.0, "x") for i in range(1200)]
    rows += [(5000 + i, "same text here", "en", "a", 0, 0.0, "x") for i in range(300)] + [(9000, None, "en", "b", 0, 0.0, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = entropy_mix.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, taken, longest = brute_targets(sizes), Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(longest[s], 0.001 * want[s])
    again = {r.doc_id: r.taken for r in entropy_mix.mix(frame.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def solved_rates(sizes, target, most=2.0):
    """Rates of the documents of one source by bisection on the dual's only multiplier."""
    mean = sum(sizes) / len(sizes)
    rate = lambda m, s: min(most, math.exp(min(m * s / mean, 50)))
    if target >= most * sum(sizes) * (1 - 1e-12):
        return dict.fromkeys(sizes, most)
    lo, hi = -80 * mean / min(sizes), math.log(most) * mean / min(sizes)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * rate(mid, s) for s in sizes) < target else (lo, mid)
    return {s: rate(lo, s) for s in sizes}


def repeated_rows(seed):
    """Rows without an id, with one of a few ids, and rows alike in everything, in four sources."""
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choices(["a", "b", "c"], k=rng.randint(1, 200)))
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), text(), "en", rng.choice(["a", "a", "b", "c", None]), k, 0.0, "x") for k in range(120)]
    rows += [(None, "one text", "en", "b", 0, 0.0, "x")] * 40 + [(3, "x " * 50, "en", "a", 0, 0.0, "x")] * 7 + [(9, None, None, "c", 0, 0.0, "x")] * 3
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_rows_that_repeat_an_id(spark, seed):
    rows = repeated_rows(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = entropy_mix.mix(frame, extra=("n_chars", "label")).collect()
    key = lambda doc, source, size, chars: (str(doc), str(source), size, chars)
    assert Counter(key(r.doc_id, r.source, r.size, r.n_chars) for r in got) == Counter(key(r[0], r[3], len((r[1] or "").split()), r[4]) for r in rows)
    of_source = defaultdict(list)
    for r in rows:
        of_source[r[3]].append(len((r[1] or "").split()))
    want = brute_targets({s: sum(v) for s, v in of_source.items()})
    taken = Counter()
    for r in got:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, sizes in of_source.items():
        assert abs(taken[s] - want[s]) <= max(sizes)
        rates = solved_rates([x for x in sizes if x], want[s])
        for r in got:
            if r.source == s and r.size:
                assert r.rate == pytest.approx(rates[r.size], abs=2e-6)
                assert abs(r.copies - r.rate) < 1 or r.copies in (math.floor(r.rate), math.ceil(r.rate))
    if seed == 1:
        return
    again = entropy_mix.mix(frame.repartition(5), extra=("n_chars", "label")).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixing_writes_out_large_groups(spark, monkeypatch):
    monkeypatch.setattr(entropy_mix, "SPREAD", 7)
    frame = spark.createDataFrame([(None, "a b", "en", "a", 0, 0.0, "x")] * 100 + [(1, "c", "en", "b", 0, 0.0, "x")], SCHEMA)
    got = entropy_mix.mix(frame).collect()
    assert len(got) == 101 and all(0 <= r.copies <= 2 for r in got)


def test_mixing_odd_and_empty_tables(docs, empty):
    assert entropy_mix.mix(docs).count() == docs.count()
    assert entropy_mix.mix(empty).count() == 0


def brute_counts(text):
    w = WORD.findall(text or "")
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rule_counts(spark, small):
    texts = [*odd_texts(), "a b c a b c\na b c\n\na b c\r\n", "# | x\ny <&>\n# | x"]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: r for r in mcd_rules.quality_rules(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = brute_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_the_rest_stays(spark, empty):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(80, 400))) for _ in range(300)]
    texts += [" ".join(w + "###" for w in rng.choices(vocab, k=150)) for _ in range(12)]
    rows = [(i, t, "en", "a", 0, 0.0, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r.kept for r in mcd_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == (i < 300) for i in got)
    assert mcd_rules.quality_rules(empty).count() == 0


def test_one_odd_statistic_is_enough(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    lines = lambda n: [" ".join(rng.choices(vocab, k=10)) for _ in range(n)]
    texts = ["\n".join(lines(30)) for _ in range(200)]
    words = "\n".join(lines(30)).split()
    symbols = [w + "#" if k % 3 == 0 else w for k, w in enumerate(words)]  # x2: about 6 % of the word characters
    passage = rng.choices(vocab, k=73)
    repeated = [*passage, *words[:75], *passage, *words[75:150]]  # x4: 49 % of the words
    copied = "\n".join(line + "\nab" for line in lines(27))  # x3: 26 of 54 lines, no repeated window
    split = lambda ws: "\n".join(" ".join(ws[k : k + 10]) for k in range(0, len(ws), 10))
    texts += [split(symbols), split(repeated), copied]
    rows = [(i, t, "en", "a", 0, 0.0, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in mcd_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i].base_failed for i in got)
    assert sorted(i for i in got if not got[i].kept) == [200, 201, 202]


def test_estimate_has_the_least_determinant_of_many_starts(spark):
    rng = np.random.default_rng(3)
    p, n, noise = len(mcd_rules.FEATURES), 400, 0.01
    clean = rng.normal(size=(310, p)) @ np.tril(rng.normal(size=(p, p)) * 0.3 + np.eye(p)).T
    x = np.concatenate([clean, rng.normal(size=(n - 310, p)) * 0.1 + 3.0])
    fields = ", ".join(["g string", *[f"{f} double" for f in (*mcd_rules.FEATURES, *mcd_rules.NOISE)]])
    judged = spark.createDataFrame([("a", *map(float, row), *[noise] * p) for row in x], fields)
    widths = spark.createDataFrame([("a", *[noise] * p)], ", ".join(["g string", *[f"w{i} double" for i in range(p)]]))
    got = mcd_rules.least_determinant(judged, widths).first()

    def scatter(rows):
        return np.cov(rows.T, bias=True) + noise * np.eye(p)

    # Plain concentration steps from random starts, with exact quantiles.
    best = np.inf
    for _ in range(200):
        core = x[rng.choice(n, p + 1, replace=False)]
        for _ in range(100):
            away = x - core.mean(axis=0)
            d2 = np.einsum("ij,jk,ik->i", away, np.linalg.inv(scatter(core)), away)
            core = x[np.argsort(d2)[: int(mcd_rules.CORE * n)]]
        if (det := np.linalg.det(scatter(core))) < best:
            best, centre = det, core.mean(axis=0)
    lower = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            lower[i, j] = got[f"l{i}{j}"]
    lower[-1, -1] = np.sqrt(lower[-1, -1] + noise)
    # Bins of distances let a few more rows than three quarters into the core.
    assert np.linalg.det(lower @ lower.T) <= 1.1 * best
    assert np.abs(np.array([got[f"c{i}"] for i in range(p)]) - centre).max() < 0.1


def test_documents_of_small_groups_are_judged_by_all(spark):
    rng = random.Random(10)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    text = lambda end="": " ".join(w + end for w in rng.choices(vocab, k=rng.randint(80, 300)))
    rows = [(i, text(), "en", "a", 0, 0.0, "x") for i in range(200)]
    rows += [(200, text(), "xx", "b", 0, 0.0, "x"), (201, text("###"), "xx", "b", 0, 0.0, "x"), (202, text("###"), None, None, 0, 0.0, "x")]
    got = {r.doc_id: r for r in mcd_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i in sorted(got) if not got[i].kept] == [201, 202]
    assert all(got[i].distance2 is not None for i in got)
    # In a small table the plain scatter stands in, by which no distance exceeds the number of rows.
    few = mcd_rules.quality_rules(spark.createDataFrame(rows[190:], SCHEMA)).collect()
    assert len(few) == 13 and all(r.kept and r.distance2 <= 12 for r in few)
    assert max(few, key=lambda r: r.distance2).doc_id in (201, 202)
    # One row more or less than ``min_group`` makes no other difference to clean documents.
    for n in (49, 51):
        assert all(r.kept for r in mcd_rules.quality_rules(spark.createDataFrame(rows[:n], SCHEMA)).collect())


def test_quality_rules_judge_repeated_rows_alike(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = [(k % 40 if k % 3 else None, " ".join(rng.choices(vocab, k=100)), "en", "a", 0, 0.0, "x") for k in range(120)]
    rows += [rows[1]] * 5 + [(7, None, "en", "a", 0, 0.0, "x"), (None, "", None, None, 0, 0.0, "x")]
    got = mcd_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert sum(r.base_failed for r in got) == 2


def brute_removed(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = {}
    for d, w in enumerate(words):
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("k", "bucket"), [(50, 1000), (50, 2), (12, 3)])
def test_substring_dedup(docs, monkeypatch, k, bucket):
    monkeypatch.setattr(superkmer, "BUCKET", bucket)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in superkmer.remove_repeats(docs, k=k, m=8).collect()}
    assert got == brute_removed(odd_texts(), k)


def test_empty_tables(empty):
    assert ngram_join.jaccard_classes(empty).count() == 0
    assert extendible.assign_shards(empty).count() == 0
    assert chunk_bpe.encode_texts(empty).count() == 0
    assert spotsigs.with_next(empty).count() == 0
    assert superkmer.remove_repeats(empty).count() == 0


def test_rows_without_an_id(spark):
    texts = odd_texts()[:6]
    frame = spark.createDataFrame(rows_of([*texts, *texts[:2]], [0, 1, 2, 3, 4, None, 7, 7]), SCHEMA)
    n = 8
    assert ngram_join.jaccard_classes(frame).count() == n
    assert extendible.assign_shards(frame).count() == n
    assert spotsigs.with_next(frame).count() == n
    assert superkmer.remove_repeats(frame).count() == n
    assert entropy_mix.mix(frame).count() == n
    path = wavelet.write_token_shards(frame)
    assert wavelet.read_token_shards(spark, path).count() == n


def test_rolling_helpers():
    x = np.random.default_rng(3).integers(0, 2**63, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 43):
        assert (sliding_min(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()
    y = np.concatenate([x[:60], x[20:60]])
    for n in (1, 4, 5, 8, 33):
        g = gram_hashes(y, n)
        assert len(g) == len(y) - n + 1
        assert (g[20 : 60 - n + 1] == g[60 : 100 - n + 1]).all()
        assert len(set(g[: 60 - n + 1].tolist())) == 60 - n + 1


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(30):
        pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 3000)))) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        maps = ngram_join.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= apart
        assert ngram_join.least_difference(ngram_join.wide_parities(a), ngram_join.wide_parities(b)) <= apart
        assert len(a) != 1 or np.bitwise_count(maps[0]).sum() == 1


def test_words_of_a_batch_are_those_of_each_text():
    rng = random.Random(4)
    texts = [b"", b" \n", b"a", b"A b\tc \x0b", "é ".encode() * 50, b"x" * 300 + b" y " + b"x" * 300, b"q" * 300_000 + b" z", *[bytes(rng.choices(b"aB \n\xc3", k=rng.randint(0, 60))) for _ in range(200)], b"w " * 100_000, b""]
    for lower in (False, True):
        words = Words(texts, lower)
        hashes, known = words.hashes(), {}
        for i, t in enumerate(texts):
            own = (t.lower() if lower else t).split()
            lo, hi = words.bounds[i], words.bounds[i + 1]
            assert [words.codes[x:y].tobytes() for x, y in zip(words.first[lo:hi], words.last[lo:hi], strict=True)] == own
            assert all(known.setdefault(w, h) == h for w, h in zip(own, hashes[lo:hi].tolist(), strict=True))
        assert len(set(known.values())) == len(known)
        owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        for n in (1, 2, 5):
            assert (words.windows(n) == (owner[n - 1 :] == owner[: len(owner) - n + 1])).all()
    assert len(Words([]).hashes()) == 0


def test_classes_of_rows_without_or_with_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = [a, a + " x", a + " y"]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows_of([*near, b, b + " z"], [5, 8, None, None, None]), SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 57, 0), (0, 58, 0), (0, 58, 5), (5, 57, 5), (8, 58, 5)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows_of([a, a, b, b], [3, 7, 7, 9]), SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (7, 3), (7, 7), (9, 7)]


def test_connected_joins_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 400)]
    random.Random(1).shuffle(chain)
    frame = spark.createDataFrame([*chain, (1000, 1001), (1001, 1002), (1003, 1002)], "a bigint, b bigint").repartition(7)
    got = {r.node: r.label for r in ngram_join.connected(frame).collect()}
    assert got == {**dict.fromkeys(range(401), 0), **dict.fromkeys(range(1000, 1004), 1000)}
    assert ngram_join.connected(frame.where("a < 0")).count() == 0


def test_prior_is_estimated_from_positives_and_unlabelled_rows_alone():
    rng = np.random.default_rng(8)
    for share in (0.3, 0.6, 0.9):
        positive = rng.normal(2, 1, 4000)
        mixed_rows = np.concatenate([rng.normal(2, 1, int(4000 * share)), rng.normal(-2, 1, int(4000 * (1 - share)))])
        assert abs(pu_quality.estimate_prior(positive, mixed_rows) - share) < 0.06


def test_quality_without_anything_to_learn_from(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = pu_quality.train(docs, none)
    assert {(r.score, r.predicted) for r in pu_quality.score(docs, model).collect()} == {(0.5, 1)}
    assert pu_quality.score(empty, pu_quality.train(empty, none)).count() == 0


def test_fit_reaches_the_least_risk():
    """Where the risk of negatives stays above 0 the risk is convex: Newton's method finds its minimum independently."""
    rng = np.random.default_rng(3)
    positive = rng.normal([1.0, 0.3, 0.0], 1.0, (400, 3))
    unlabelled = np.concatenate([rng.normal([1.0, 0.3, 0.0], 1.0, (300, 3)), rng.normal([-1.0, -0.3, 0.0], 1.2, (700, 3))])
    prior, decay = 0.3, 1e-3
    model = pu_quality.fit(positive, unlabelled, prior, epochs=3000, decay=decay)
    p, u = (np.c_[model.expand(x), np.ones(len(x))] for x in (positive, unlabelled))
    keep = np.append(np.ones(p.shape[1] - 1), 0.0)

    def parts(w):
        return prior * np.logaddexp(0, -p @ w).mean(), np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()

    def risk(w):
        good, bad = parts(w)
        return good + max(0.0, bad) + decay / 2 * (keep * w * w).sum()

    w = np.zeros(p.shape[1])
    for _ in range(100):
        s = 1 / (1 + np.exp(-u @ w))
        slope = -prior * p.mean(axis=0) + u.T @ s / len(u) + decay * keep * w
        bend = (u * (s * (1 - s))[:, None]).T @ u / len(u) + np.diag(decay * keep + 1e-12)
        w -= np.linalg.solve(bend, slope)
    assert parts(w)[1] > 0 and np.abs(slope).max() < 1e-9
    got = np.append(model.weights, model.bias)
    assert risk(w) <= risk(got) <= risk(w) + 1e-4
    both = np.r_[p, u]
    assert ((both @ got > 0) == (both @ w > 0)).mean() > 0.99


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_decoding_takes_the_codeword_of_least_loss(n):
    rng = np.random.default_rng(n)
    size = 2 << ecoc_lang.BUCKET_BITS
    model = ecoc_lang.Model({f"l{i}": rng.poisson(rng.gamma(0.3, 3, size)) for i in range(n)})
    margins = rng.normal(0, 0.5 / model.scale, (50, model.code.shape[1]))
    best, score, unsure = model.decode(margins)
    for k, row in enumerate(margins):
        loss = [sum(model.loss_weights[i, b] * math.exp(max(-30, min(30, -row[b] * model.scale * model.code[i, b]))) for b in range(len(row))) for i in range(n)]
        order = sorted(range(n), key=lambda i: loss[i])
        assert loss[best[k]] == pytest.approx(loss[order[0]])
        if n > 1:
            assert score[k] == pytest.approx(min(1, max(0, 1 - loss[order[0]] / loss[order[1]])), abs=1e-9)
            assert bool(unsure[k]) == (score[k] < ecoc_lang.AMBIGUOUS)


def test_margins_of_whole_texts_by_definition(spark):
    """The classifiers' answers for a text from its letter pairs and triples, counted one by one."""
    docs = spark.createDataFrame(rows_of(["the cat sat on the mat", "le chat est sur le tapis", "der hund ist im haus"] * 20), SCHEMA)
    docs = docs.withColumn("lang", F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (F.col("doc_id") % 3 + 1).cast("int")))
    model = ecoc_lang.train(docs)
    texts = ["the dog", "chat noir", "haus", "a", "É"]
    got = {r.doc_id: r for r in ecoc_lang.predict(spark.createDataFrame(rows_of(texts), SCHEMA), model).collect()}
    for i, t in enumerate(texts):
        pair, triple, (n2, n3), _ = ecoc_lang.grams_of([t.encode()])
        margin = np.zeros(model.code.shape[1])
        for grams, n in ((pair, int(n2[0])), (triple, int(n3[0]))):
            for b in range(len(margin)):
                margin[b] += sum(float(model.weights[g, b]) for g in grams.tolist()) / max(n, 1) / 2
        best, score, _ = model.decode(margin[None])
        assert got[i].lang_pred == model.langs[best[0]]
        assert got[i].score == pytest.approx(score[0], abs=1e-4)
