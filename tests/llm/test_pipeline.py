"""The pipeline stage by stage against brute force on the smallest table."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as pipeline
from test_operators import SCHEMA, WORD, brute_classes, brute_removed, brute_targets, library, repeated_rows


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(path := f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(path)
        steps.append([r.asDict() for r in docs.collect()])
        if i < 4:
            assert set(docs.columns) == set(pipeline.COLUMNS)
    good, single, cut, mixed, tokens = steps

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) > 0.9 * len(labels)

    good.sort(key=lambda r: r["doc_id"])
    classes = brute_classes([r["text"] for r in good], 5, 80)
    assert {r["doc_id"] for r in single} == {r["doc_id"] for i, r in enumerate(good) if classes[i][1] == i}

    single.sort(key=lambda r: r["doc_id"])
    removed = brute_removed([r["text"] for r in single], 50)
    want = {r["doc_id"]: removed[i] for i, r in enumerate(single) if removed[i][1] == 0 or removed[i][1] < removed[i][0]}
    assert {r["doc_id"] for r in cut} == set(want)
    for r in cut:
        assert len(WORD.findall(r["text"])) == want[r["doc_id"]][0] - want[r["doc_id"]][1]
        assert r["n_chars"] == len(r["text"])

    sizes, taken = Counter(), Counter()
    for r in cut:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    longest = max(len(WORD.findall(r["text"])) for r in cut)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= longest
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 2

    lib, texts = library(), {r["doc_id"]: r["text"] for r in cut}
    assert Counter(r["doc_id"] for r in tokens) == Counter(r["doc_id"] for r in mixed)
    for r in tokens:
        assert r["ids"] == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_run_gives_the_last_stage(spark, small):
    got = pipeline.run(spark, small)
    assert {"doc_id", "n_tokens", "ids"} <= set(got.columns)
    assert got.count() > 0


def test_near_duplicates_keep_one_row_of_each_class(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, class_key string"
    rows = [(5, a + " x"), (4, a), (4, a), (None, a), (4, b), (None, b + " y"), (None, "c d e"), (None, "c d e"), (1, None), (1, None), (2, " ")]
    docs = spark.createDataFrame([(i, t, None, "s", None, 0, "x") for i, t in rows], schema)
    got = pipeline.near_duplicates(spark, docs, "")
    assert tuple(got.columns) == pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(4, a), (4, b), (None, "c d e"), (1, None), (1, None), (2, " ")])
    assert pipeline.near_duplicates(spark, docs.where("doc_id > 9"), "").count() == 0


def test_mixture_gives_every_row_copies_of_its_own(spark):
    rows = repeated_rows(4)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in pipeline.mixture(spark, docs, "").collect()]
    there, mixed = Counter(r[:5] for r in rows), Counter(got)
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        n = len((r[1] or "").split())
        sizes[r[3]] += n
        longest[r[3]] = max(longest[r[3]], n)
    for r in got:
        taken[r[3]] += len((r[1] or "").split())
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= longest[source]
    for r, n in mixed.items():
        assert n <= 2 * there[r]
    assert mixed[9, None, None, "c", 0] == 3


def test_stages_take_empty_tables(spark, small):
    """No stage needs a document; the first needs labels to learn from, and has none to judge."""
    none = spark.createDataFrame([], SCHEMA).select(*pipeline.COLUMNS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, small).count() == 0

#: Names that stages use themselves, as further columns of the documents.
CLASHING = ("row", "ranges", "kept", "n_words", "doc_key", "_text", "predicted", "score", "ids", "class_key", "copies")
SHARED = " ".join(f"s{i}" for i in range(60))


def odd_documents(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, None, None, None, *CLASHING) for i, t in rows], schema)


ODD = [(7, "own " + SHARED), (7, SHARED + " end"), (8, "x y " + SHARED + " tail"), (None, SHARED), (None, SHARED), (None, f"p {SHARED} q"), (3, None), (3, None), (4, ""), (5, " \n"), (None, None)]


def test_quality_judges_alike_rows_alike(spark, small):
    there = spark.read.parquet(f"{small}/documents.parquet").select(*pipeline.COLUMNS)
    docs = odd_documents(spark, ODD).unionByName(there, allowMissingColumns=True)
    got = pipeline.quality(spark, docs, small)
    assert tuple(got.columns) == pipeline.COLUMNS
    kept, given = Counter(map(tuple, got.collect())), Counter(tuple(r) for r in docs.select(*pipeline.COLUMNS).collect())
    assert 0 < kept.total() < given.total()
    assert all(n == given[r] for r, n in kept.items())


def test_substrings_of_rows_without_or_with_repeated_ids(spark):
    """Rows of one id leave each other alone, rows without an id come last, rows without text stay as they are."""
    got = pipeline.substrings(spark, odd_documents(spark, ODD), "")
    assert set(got.columns) == set(pipeline.COLUMNS)
    want = [(7, "own " + SHARED), (7, SHARED + " end"), (8, "x y tail"), (None, "p q"), (3, None), (3, None), (4, ""), (5, " \n"), (None, None)]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == Counter((i, t, None if t is None else len(t)) for i, t in want)


def test_tokens_of_rows_without_or_with_repeated_ids(spark):
    lib = library()
    got = pipeline.tokens(spark, odd_documents(spark, ODD), "").collect()
    want = Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_take_texts_of_a_million_words(spark):
    rng = random.Random(5)
    long = " ".join(rng.choices([f"w{i}" for i in range(30_000)], k=1_000_000))
    docs = odd_documents(spark, [(1, long), (2, "head " + long), (3, "short text")])
    assert sorted((r.doc_id, len(r.text)) for r in pipeline.near_duplicates(spark, docs, "").collect()) == [(1, len(long)), (3, 10)]
    assert {r.doc_id: r.text for r in pipeline.substrings(spark, docs, "").collect()} == {1: long, 2: "head", 3: "short text"}
    ids = {r.doc_id: r.ids for r in pipeline.tokens(spark, docs, "").collect()}
    assert ids[1] == library().encode(long, add_special_tokens=False).ids
    assert set(ids) == {1, 2, 3}
