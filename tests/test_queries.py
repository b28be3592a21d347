"""Registered queries against their SQL on the smallest tables, and operators on small literal cases."""

from __future__ import annotations

import glob
import hashlib
import itertools
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave import registry
from signalweave.functions import expressions as X
from signalweave.operators import graph, history, journal, telemetry, text

#: Loops of 40 rounds: compared with SQL by the driver, too slow for a unit test.
SLOW = {"pagerank", "node_stats", "personalized_pagerank", "task_neighbors", "rank_tiers", "segment_map", "personalized_top", "graph_export"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, duck, small, name):
    got = registry.queries()[name](spark, small)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted(tuple(shown(r[c]) for c in cols) for r in got.collect())
    assert rows == sorted(tuple(shown(v) for v in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_paths(spark):
    p = F.lit("src/core/deep/Name.test.TS")
    assert one(spark, X.extension(p)) == ".ts"
    assert one(spark, X.basename(p)) == "Name.test.TS"
    assert one(spark, X.stem(p)) == "Name.test"
    assert one(spark, X.zone_dir(p)) == "src/core/deep"
    assert one(spark, X.zone_top(p)) == "src"
    assert one(spark, X.zone_two(p)) == "src/core"
    assert one(spark, X.zone_two(F.lit("readme.md"))) == "(root)"
    assert one(spark, X.zone_ancestors(p)) == ["src", "src/core", "src/core/deep"]
    assert one(spark, X.zone_ancestors(F.lit("a"))) == []
    assert one(spark, X.in_derived_zone(F.lit("a/dist/b"), ["dist"])) is True


def test_ratings(spark):
    def lower(p, n, z=1.64):
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)

    assert one(spark, X.wilson_lower(F.lit(0.9), F.lit(20))) == pytest.approx(lower(0.9, 20))
    assert one(spark, X.wilson_lower(F.lit(0.9), F.lit(0))) is None
    names = {(p, n): one(spark, X.tier(F.lit(p), F.lit(n))) for p, n in [(1.0, 100), (1.0, 5), (0.9, 20), (0.55, 9), (0.4, 1000)]}
    assert names == {(1.0, 100): "law", (1.0, 5): "habit", (0.9, 20): "habit", (0.55, 9): "hypothesis", (0.4, 1000): None}
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, X.init_rating(F.lit(0.8), F.lit(10), no)) == pytest.approx(9 / 12)
    assert one(spark, X.init_deviation(F.lit(0.8), F.lit(10), no)) == pytest.approx((9 / 12 * 3 / 12 / 13) ** 0.5)
    assert one(spark, X.init_rating(F.lit(1.0), F.lit(10), yes)) == pytest.approx(5 / 6)
    assert one(spark, X.confirm_rating(F.lit(0.5), F.lit(0.2), F.lit(0.8), F.lit(0.1))) == pytest.approx(0.5 + 0.8 * 0.3)
    assert one(spark, X.confirm_deviation(F.lit(0.2), F.lit(0.1))) == pytest.approx((1 / (1 / 0.04 + 1 / 0.01)) ** 0.5)
    assert one(spark, X.effective_deviation(F.lit(0.1), F.lit(365.0))) == pytest.approx((0.01 + 0.04) ** 0.5)
    assert one(spark, X.effective_deviation(F.lit(0.1), F.lit(-5.0))) == pytest.approx(0.1)
    assert one(spark, X.effective_deviation(F.lit(0.1), F.lit(1e6))) == pytest.approx(12**-0.5)
    assert [one(spark, X.live_tier(F.lit(0.95), F.lit(d))) for d in (0.02, 0.1, 0.25)] == ["law", "habit", "hypothesis"]
    assert one(spark, X.live_tier(F.lit(0.3), F.lit(0.01))) == "no_consensus"
    assert one(spark, X.retrievability(F.lit(14.0), F.lit(14.0))) == pytest.approx(0.9)
    late, early = (one(spark, X.confirm_stability(F.lit(14.0), F.lit(r))) for r in (0.5, 0.95))
    assert 14 < early < late <= 365
    assert one(spark, X.fact_key(F.lit("naming"), F.lit("camel — 90 of 100"))) == "naming|camel"
    assert one(spark, X.hamming(F.lit(5), F.lit(6))) == 2


@pytest.mark.parametrize(("listed", "wanted", "allowed"), [
    (["https://*.example.org:443/a"], "cdn.example.org", True), (["https://*.example.org:443/a"], "example.com", False), (["https://*.example.org"], "https://a.example.org/x", True),
    (["https:"], "example.com", True), (["https:"], "https://example.com", True), (["https:"], "http://example.com", False), (["https:"], "host:8080", True),
    (["https:"], "blob:", False), (["https:"], "data:", False), (["https:"], "'unsafe-inline'", False), (["https:"], "'nonce-a.b'", False), (["https:"], "localhost", False),
    (["https://Example.com/x"], "example.com", True), (["https://Example.com/x"], "ample.com", False), (["a.com"], "a.com:443", True),
    (["'none'"], "x.org", False), (["'none'", "a.com"], "a.com", False), (["*"], "'unsafe-inline'", True), (["'self'"], "'SELF'", True), (["data:"], "data:image/png", True),
    (["blob:"], "blob:", True), ([], "a.com", False), (None, "a.com", True), (None, "'unsafe-eval'", True), (["a.com"], None, None),
])
def test_allowed_sources(spark, listed, wanted, allowed):
    row = spark.createDataFrame([(listed, wanted)], "listed array<string>, wanted string")
    assert row.select(X.csp_allows(F.col("listed"), F.col("wanted")).alias("v")).first().v is allowed


def test_directives_fall_back_on_the_default(spark):
    rows = spark.createDataFrame([({"default-src": ["a.com"], "img-src": ["'none'"]},), ({"img-src": ["b.com"]},)], "policy map<string, array<string>>")
    got = [r.v for r in rows.select(X.csp_values(F.col("policy"), F.lit("font-src")).alias("v")).collect()]
    assert got == [["a.com"], None]
    assert rows.select(X.csp_values(F.col("policy"), F.lit("img-src")).alias("v")).first().v == ["'none'"]


def test_cochange_leaves_large_commits_out(spark):
    rows = [("r", "c1", "a"), ("r", "c1", "b"), ("r", "c2", "b"), ("r", "c2", "a"), ("r", "c2", "a"), ("r", "c3", "a")]
    rows += [("r", "big", f"f{i}") for i in range(40)]
    files = spark.createDataFrame(rows, "repo string, sha string, path string")
    assert [(r.a, r.b, r.n) for r in history.cochange(files).collect()] == [("a", "b", 2)]
    totals = {r.file: r.n for r in history.cochange_totals(files).collect()}
    assert totals == {"a": 3, "b": 2}


def test_cochange_of_a_larger_table_has_more_tasks_and_the_same_pairs(spark, monkeypatch):
    files = spark.range(600).selectExpr("'r' AS repo", "id DIV 3 AS sha", "(id * 7) % 11 AS path")
    few = sorted(tuple(r) for r in history.cochange(files).collect())
    monkeypatch.setattr(history, "TASK_ROWS", 50)
    dealt = history.cochange(files)
    assert f"{12 * history.PAIR_TASKS}), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert few and sorted(tuple(r) for r in dealt.collect()) == few


def test_journal_keeps_one_row_of_a_key_in_force(spark):
    now = F.lit("2030-01-02 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], journal.JOURNAL)
    facts = lambda *rows: spark.createDataFrame([("r", *x) for x in rows], "repo string, area string, statement string, prevalence double, positive bigint, total bigint")
    first = journal.assert_facts(empty, facts(("n", "camel — 9", 0.9, 9, 10), ("q", "single — 5", 0.8, 8, 10)), "m", now)
    assert {r.outcome for r in first.collect()} == {"born"}
    second = journal.assert_facts(first.drop("outcome"), facts(("n", "camel — 9", 1.0, 20, 20), ("q", "single — 6", 0.7, 7, 10), ("z", "new", 0.6, 6, 10)), "m", now)
    rows = second.collect()
    assert sorted(r.outcome for r in rows) == ["born", "changed", "confirmed", "superseded"]
    assert len({r.id for r in rows}) == 4
    live = [r.key for r in rows if r.superseded_by is None]
    assert len(live) == len(set(live)) == 3
    kept = spark.createDataFrame([("r", "n|camel")], "repo string, key string")
    gone = journal.retract_missing(second.drop("outcome"), kept, "m").where("superseded_by = 0").collect()
    assert sorted(r.key for r in gone) == ["q|single", "z|new"]


def test_confirming_a_modelled_fact_blends_with_what_was_seen(spark):
    now, later = (F.lit(f"2030-01-{d} 00:00:00").cast("timestamp") for d in ("02", "16"))
    fact = spark.createDataFrame([("r", "n", "camel", 1.0, 20, 20)], "repo string, area string, statement string, prevalence double, positive bigint, total bigint")
    first = journal.assert_facts(spark.createDataFrame([], journal.JOURNAL), fact, "m", now, modelled=True).drop("outcome")
    born = first.first()
    row = journal.assert_facts(first, fact, "m", later, modelled=True).first()
    assert (born.rating, born.stability) == (pytest.approx(5 / 6), 14.0)
    assert (row.rating, row.deviation) == (pytest.approx(born.rating), pytest.approx(born.deviation / 2**0.5))
    assert row.confirmations == 2 and row.stability == pytest.approx(14 * (1 + math.exp(1.49) * 6 * 14**-0.14 * (math.exp(0.94 * 0.1) - 1)))


def test_views_of_a_journal(spark):
    at = lambda d: F.lit(f"2030-{d} 00:00:00").cast("timestamp")
    facts = lambda *rows: spark.createDataFrame([("r", *x) for x in rows], "repo string, area string, statement string, prevalence double, positive bigint, total bigint")
    measured = journal.assert_facts(spark.createDataFrame([], journal.JOURNAL), facts(("n", "camel — 9", 0.9, 18, 20), ("q", "single — 5", 0.8, 8, 10)), "count", at("01-01")).drop("outcome")
    both = journal.assert_facts(measured, facts(("n", "camel — 10", 1.0, 200, 200)), "count", at("01-11")).drop("outcome")
    history = [(r.key, r.version, r.in_force, r.statement) for r in journal.fact_history(both).orderBy("key", "version").collect()]
    assert history == [("n|camel", 1, True, "camel — 10"), ("n|camel", 2, False, "camel — 9"), ("q|single", 1, True, "single — 5")]
    touched = {(r.key, r.superseded_by is None): str(r.seen_at)[:10] for r in journal.touch_all(both, at("02-01")).collect()}
    assert touched == {("n|camel", True): "2030-02-01", ("n|camel", False): "2030-01-01", ("q|single", True): "2030-02-01"}
    modelled = journal.assert_facts(spark.createDataFrame([], journal.JOURNAL), facts(("z", "guess", 0.9, 1, 1)), "model:a", at("01-01"), modelled=True).drop("outcome")
    assert journal.due_for_review(modelled, at("01-10")).count() == 0
    assert journal.due_for_review(modelled.unionByName(both), at("01-20")).count() == 1
    merged = journal.merge_journals(both, modelled.unionByName(modelled.withColumn("key", F.lit("q|single"))), "model:")
    assert sorted(r.key for r in merged.collect()) == ["n|camel", "n|camel", "q|single", "z|guess"]
    live = {r.key: r.live_tier for r in journal.active_facts(both, at("01-11")).collect()}
    assert live == {"n|camel": "law", "q|single": "hypothesis"}
    lines = {(r.tier, r.area): r.lines for r in journal.summary_sections(both.where("superseded_by IS NULL")).collect()}
    assert lines == {("law", "n"): ["camel — 10"], ("hypothesis", "q"): ["single — 5"]}


def test_the_latest_row_of_a_key_does_not_depend_on_the_order_of_rows(spark):
    base = spark.createDataFrame([(1, 5, "a"), (2, 5, "x"), (3, None, "n")], "k int, o int, v string")
    delta = spark.createDataFrame([(1, 5, "b"), (1, 5, "c"), (2, 4, "y"), (3, 1, "m")], "k int, o int, v string")
    for d in (delta, delta.orderBy(F.desc("v"))):
        assert {r.k: r.v for r in journal.upsert_latest(base, d, ["k"], "o").collect()} == {1: "c", 2: "x", 3: "m"}


def brute_ranks(nodes, edges, teleport, damping, iters, own):
    links = {v: sorted({d for s, d in edges if s == v}) for v in nodes}
    rank = dict(teleport)
    for _ in range(iters):
        loose = sum(rank[v] for v in nodes if not links[v])
        new = {v: own * rank[v] + (1 - own) * loose * teleport[v] for v in nodes}
        for v in nodes:
            for d in links[v]:
                if d in new:
                    new[d] += (1 - own) * rank[v] / len(links[v])
        rank = {v: (1 - damping) * teleport[v] + damping * new[v] for v in nodes}
    return rank


def test_ranks_with_hubs_and_nodes_without_links(spark, monkeypatch):
    """Two repos; the links of nodes with more than two are dealt in parts; half of the nodes lead nowhere."""
    monkeypatch.setattr(graph, "HUB", 2)
    rng = random.Random(2)
    edges = {("a", rng.randrange(8), rng.randrange(16)) for _ in range(40)} | {("b", 0, i) for i in range(1, 9)}
    edges = {e for e in edges if e[1] != e[2]}
    nodes = {r: range(n) for r, n in (("a", 16), ("b", 9))}
    v = spark.createDataFrame([(r, n) for r, ns in nodes.items() for n in ns], "repo string, node int")
    e = spark.createDataFrame(sorted(edges), "repo string, src int, dst int")
    seeds = spark.createDataFrame([("a", 3, 50.0)], "repo string, node int, weight double")
    plain = {(r.repo, r.node): r["rank"] for r in graph.pagerank(v, e, iters=5).collect()}
    own = {(r.repo, r.node): r["rank"] for r in graph.personalized_pagerank(v, e, seeds, iters=5).collect()}
    for repo, ns in nodes.items():
        links = [(s, d) for r, s, d in edges if r == repo]
        want = brute_ranks(ns, links, dict.fromkeys(ns, 1 / len(ns)), 0.85, 5, 0.0)
        assert {n: plain[repo, n] for n in ns} == pytest.approx(want)
        weights = {n: 50.0 if (repo, n) == ("a", 3) else 1.0 for n in ns}
        want = brute_ranks(ns, links, {n: w / sum(weights.values()) for n, w in weights.items()}, 0.85, 5, 0.1)
        assert {n: own[repo, n] for n in ns} == pytest.approx(want)
        assert sum(plain[repo, n] for n in ns) == pytest.approx(1.0)


@pytest.mark.parametrize("iters", [1, 4])
def test_ranks_of_several_blocks(spark, monkeypatch, iters):
    """Nodes of any type in blocks of three, with links to what is no node."""
    monkeypatch.setattr(graph, "WIDTH", 3)
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(14)}") for _ in range(30)} - {(f"n{i}", f"n{i}") for i in range(9)})
    nodes = [f"n{i}" for i in range(12)]
    got = graph.pagerank(spark.createDataFrame([("r", n) for n in nodes], "repo string, node string"), spark.createDataFrame([("r", *e) for e in edges], "repo string, src string, dst string"), iters=iters)
    want = brute_ranks(nodes, edges, dict.fromkeys(nodes, 1 / 12), 0.85, iters, 0.0)
    assert {r.node: r["rank"] for r in got.collect()} == pytest.approx(want)


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    got = graph.components(links.unionByName(spark.createDataFrame([(9001, 9000)], "a bigint, b bigint"))).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(3001)} | {9000: 9000, 9001: 9000}


def test_components_of_a_mixed_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    roots = graph._roots
    monkeypatch.setattr(graph, "_roots", lambda links: rounds.append(1) or roots(links) if len(rounds) < 5 else pytest.fail("too many rounds"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([((i * 7919) % 3000, (i * 7919) % 3000 + 1) for i in range(3000)], "a bigint, b bigint").repartition(4, "a")
        got = {(r.node, r.component) for r in graph.components(links).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(i, 0) for i in range(3001)}


def test_links_without_their_nodes_are_dropped(spark):
    edges = spark.createDataFrame([("r", 1, 2), ("r", 2, 3), ("s", 1, 2)], "repo string, src int, dst int")
    nodes = spark.createDataFrame([("r", 1), ("r", 2), ("s", 1)], "repo string, node int")
    assert [tuple(r) for r in graph.drop_dangling(edges, nodes).collect()] == [("r", 1, 2)]


def test_near_hashes_finds_every_pair(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    hashes = base + [b ^ sum(1 << i for i in rng.sample(range(64), d)) for b in base for d in (1, 3, 4, 4, 5)]
    # One flipped bit in each quarter, and the sign bit.
    hashes += [base[0] ^ 0x8000000100010001, base[1] ^ (1 << 63), base[2]]
    rows = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "id bigint, hash bigint")
    first = {h: i for i, h in reversed(list(enumerate(hashes)))}
    want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in first.values() for j in first.values() if i < j and (hashes[i] ^ hashes[j]).bit_count() <= 4}
    assert {tuple(r) for r in text.near_hashes(rows).collect()} == want
    assert {tuple(r) for r in text.near_hashes(rows, blocks=8).collect()} == want


def test_clones_do_not_depend_on_where_a_passage_begins(spark):
    passage = "\n".join(f"a line of the passage that is long enough, part {c}" for c in "abc")
    docs = spark.createDataFrame([(1, passage), (2, "one more line\n\n" + passage), (3, "other")], "id bigint, text string")
    assert [(r.n, r.docs) for r in text.exact_clones(text.line_blocks(docs, 3)).collect()] == [(2, 2)]


def test_texts_without_a_token_have_hash_zero(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b !"), (4, "token")], "id bigint, text string")
    got = {r.id: r.hash for r in text.simhash64(docs).collect()}
    assert [got[i] for i in (1, 2, 3)] == [0, 0, 0] and got[4] != 0


@pytest.mark.parametrize("name", ["simhash64", "near_clones", "greedy_clones"])
def test_clones_of_odd_texts_equal_sql(spark, tmp_path, name):
    """Letters whose lower case is special, texts that are null or without a token, and negative ids."""
    rng = random.Random(3)
    words = ["alpha", "beta", "İstanbul", "aİb", "İ", "ı", "KELVIN", "\u212aelvin", "ſtreet", "ΣΑΣ", "ẞETA", "éa", "ДОМ", "ЁЛКА", "x\0yz", "日本", "١٢٣", "ﬁne", "😀", "a\u00adbc", "n\r\nm"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in range(-300, 300)] + [(300, None), (301, ""), (302, " ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).select(want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_votes_of_tokens_of_many_texts(spark, monkeypatch):
    """More tokens than are remembered, and rows that repeat an id; each token is hashed once a text."""
    monkeypatch.setattr(text, "KNOWN_TOKENS", 3)
    rng = random.Random(8)
    rows = [(i // 2, " ".join(rng.choice(["alpha", "beta", "gammaray", "delta", "ёлка", "x1"]) + str(rng.randrange(9)) for _ in range(rng.randrange(30)))) for i in range(40)]
    want = {}
    for i in range(20):
        votes = [0] * 64
        for t in " ".join(r for k, r in rows if k == i).split():
            h = int(hashlib.sha1(t[:5].encode()).hexdigest()[:16], 16)
            votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
        h = sum(1 << b for b, v in enumerate(votes) if v > 0)
        want[i] = h - (1 << 64) if h >> 63 else h
    got = text.simhash64(spark.createDataFrame(rows, "id bigint, text string"))
    assert {r.id: r.hash for r in got.collect()} == want


def test_heat_halves(spark):
    rows = spark.createDataFrame([("a", "2030-01-01 00:00:00"), ("a", "2030-01-04 00:00:00")], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = telemetry.decayed_heat(rows, F.lit("2030-01-04 00:00:00").cast("timestamp")).first()
    assert got.heat == pytest.approx(1.5)


@pytest.mark.parametrize("scanned", [0, 1_000_000])
def test_greedy_dedupe_is_that_of_a_scan(spark, scanned):
    """Components scanned in tasks, and settled in rounds over tasks."""
    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(3, 3), (5, 999), (61, 62), (62, 63)]
    kept = {}
    for i in range(70):
        kept[i] = not any(kept[min(p)] for p in pairs if max(p) == i and min(p) < i)
    got = text.greedy_dedupe(spark.range(70), spark.createDataFrame(pairs, "a bigint, b bigint"), scanned)
    assert {r.id: r.kept for r in got.collect()} == kept


def test_greedy_dedupe_of_a_long_chain(spark):
    got = text.greedy_dedupe(spark.range(10_001), spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.where(F.col("kept") == (F.col("id") % 2 == 0)).count() == 10_001


def test_greedy_dedupe_of_large_and_small_components_together(spark):
    """A small component stays in one task when the large ones are left out by a join that Spark turns into a broadcast."""
    chains = [(i, i + 1) for i in range(1500) if i % 5 < 4]
    pairs = spark.createDataFrame(chains + [(a, b) for b in range(2000, 2060) for a in range(2000, b)], "a bigint, b bigint")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "32k"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = text.greedy_dedupe(pairs.selectExpr("explode(array(a, b)) AS id"), pairs, scanned=1000).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted((r.id, r.kept) for r in got) == [(i, i % 5 % 2 == 0) for i in range(1500)] + [(i, i == 2000) for i in range(2000, 2060)]


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize(("few", "crowd"), [(0, 1_000_000), (0, 7), (40, 7), (1000, 7)])
def test_greedy_hashes_is_a_scan_of_all_pairs(spark, few, crowd):
    """By rounds alone, with keys in parts, and with the rest or all by a list of pairs."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(5)]
    hashes = [rng.choice(base) ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for _ in range(250)] + [rng.getrandbits(64) for _ in range(50)]
    first, kept = {}, {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    for h, i in first.items():
        kept[i] = not any(kept[j] and (h ^ g).bit_count() <= 4 for g, j in first.items() if j < i)
    rows = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "id bigint, hash bigint")
    assert {r.id: r.kept for r in text.greedy_hashes(rows, few=few, crowd=crowd).collect()} == kept


def test_greedy_hashes_of_a_long_chain(spark):
    """Each hash is near to the one before it and the one after it alone, which rounds are slow on."""
    hashes = [0]
    for i in range(400):
        step = [(3 * i + k) % 64 for k in range(3)]
        hashes.append(hashes[-1] ^ sum(1 << b for b in step))
    kept, seen = {}, {}
    for i, h in enumerate(hashes):
        if h not in seen:
            seen[h] = i
            kept[i] = not any(kept[j] and (h ^ g).bit_count() <= 4 for g, j in seen.items() if j < i)
    rows = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "id bigint, hash bigint")
    assert {r.id: r.kept for r in text.greedy_hashes(rows, few=0).collect()} == kept


def test_greedy_clones_lists_no_pairs_of_a_large_group(spark, small, monkeypatch):
    """2,016 hashes of which each two are near, hence two million pairs."""
    group = [(i, signed((1 << 63) ^ (1 << a) ^ (1 << b))) for i, (a, b) in enumerate(itertools.combinations(range(64), 2))]
    hashes = spark.createDataFrame([*group, (5000, 0x0F0F0F0F0F0F0F0F), (5001, 0x0F0F0F0F0F0F0F0F), (None, 0x00FF00FF00FF00FF)], "id bigint, hash bigint")
    monkeypatch.setattr(text, "simhash64", lambda docs: hashes)
    monkeypatch.setattr(text, "near_hashes", lambda *a: pytest.fail("pairs are listed"))
    monkeypatch.setattr(text, "FEW", 0)
    got = {r.id: r.kept for r in registry.queries()["greedy_clones"](spark, small).collect()}
    assert len(got) == 2018 and {i for i, k in got.items() if k} == {0, 5000, None}


def test_hashes_beaten_in_a_large_group():
    """Several tiles of sources and of targets, against all pairs."""
    rng = np.random.default_rng(4)
    hashes = np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 40, 6000).astype(np.uint64) for _ in range(5)])
    source, target = rng.random(6000) < 0.3, rng.random(6000) < 0.8
    near = (np.bitwise_count(hashes[:, None] ^ hashes[None, :]) <= 2) & (hashes[:, None] != hashes[None, :])
    want = (np.tril(near, -1) & source[None, :]).any(axis=1) & target
    assert 0 < want.sum() < target.sum()
    assert sorted(text._beaten_in_group(hashes, source, target, 2).tolist()) == np.flatnonzero(want).tolist()


def test_recent_rows_and_even_samples(spark):
    rows = spark.createDataFrame([(s, i) for s in "abc" for i in range(3)], "session_id string, i int")
    sessions = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "session_id string, start int")
    assert {r.session_id for r in telemetry.keep_recent(rows, sessions, 2).collect()} == {"b", "c"}
    assert sorted(r.id for r in telemetry.sample_systematic(spark.range(100).repartition(5), "id", 10).collect()) == list(range(0, 100, 10))
    assert sorted(r.id for r in telemetry.sample_systematic(spark.range(3), "id", 10).collect()) == [0, 1, 2]


def test_links_in_any_quotes(spark):
    html = """<a href="/x">One</a> <a class=b href='/y?q=1'>T<b>wo</b></a> <A HREF=/z id=1>three
    3</A> <a href="#top">up</a> <a href=''>none</a> <a name="q">no link</a>"""
    got = [(r.target, r.anchor) for r in text.page_links(spark.createDataFrame([(1, html)], "page_id bigint, html string")).collect()]
    assert got == [("/x", "one"), ("/y?q=1", "two"), ("/z", "three 3")]


def test_rules_and_diffs(spark):
    files = spark.createDataFrame([("a", "timeout = 3"), ("b", "none")], "path string, content string")
    rules = spark.createDataFrame([("t", r"timeout\s*="), ("bad", r"(a+)+"), ("x", "no")], "rule_id string, pattern string")
    assert [(r.path, r.rule_id) for r in text.apply_rules(files, rules).collect()] == [("a", "t")]
    diffs = spark.createDataFrame([("p", "--- a\n+++ b\n-check()\n+eval(x)"), ("q", "-check()\n+check()")], "path string, diff string")
    got = text.diff_regressions(diffs, {"check": "check"}, {"eval": "eval"}).collect()
    assert sorted((r.path, r.kind) for r in got) == [("p", "check"), ("p", "eval")]


def test_words_of_two_scripts(spark):
    docs = spark.createDataFrame([(1, "plain words, обычные слова"), (2, "the wоrd and the wоrd; `cоde` http://x/у a/бb"), (3, None)], "id bigint, text string")
    assert [(r.id, r.words) for r in text.mixed_script_words(docs).collect()] == [(2, ["wоrd"])]
