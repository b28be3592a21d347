"""The prefix trie against brute force: all prefixes of all conversations, written out."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalweave.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, depth int, component string, len int"


def rows_of(turns):
    # Extra columns bear names that the operator uses itself.
    return [(*t, "k", 1, "c", 2) for t in turns]


def some_turns(seed=4, n=60):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(200), n):
        for k in range(rng.choice([0, 1, 2, 3, 8, 12])):
            out.append((c, None if k == 0 and rng.random() < 0.3 else k, rng.choice(["user", "user", None]), rng.choice(["a", "a", "b", "", None, "çé"])))
    # A long conversation, copies of one, equal rows, rows without a conversation.
    out += [(300, k, "user", f"t{k % 3}") for k in range(150)]
    out += [(c, k, "user", f"same {k}") for c in range(301, 330) for k in range(4)]
    out += [(331, 5, "user", "twice"), (331, 5, "user", "twice"), (None, 1, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(out)
    return out


def in_order(turns):
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in convs.items()}


def brute(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, found in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(found) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def collected(nodes):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


@pytest.mark.parametrize("local", [1, 200, 1_000_000])
def test_trie(spark, local):
    """With components of one turn all rounds run over the cluster, with the largest none does."""
    turns = some_turns(n=12 if local == 1 else 60)
    if local == 1:
        turns = [t for t in turns if t[0] != 300] + [(300, k, "user", f"t{k % 3}") for k in range(20)]
    found = prefix_trie.digests(spark.createDataFrame(rows_of(turns), SCHEMA))
    nodes = prefix_trie.trie(found, found.select("conv_id").distinct(), local=local)
    assert collected(nodes) == brute(in_order(turns))


def test_rebuilt_conversations(spark):
    turns = some_turns(seed=9)
    own = in_order(turns)
    convs = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - c % 5, [])[:h] + seq[h:]
    found = prefix_trie.digests(spark.createDataFrame(rows_of(turns), SCHEMA))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    nodes = prefix_trie.trie(*prefix_trie.branched(found, F.col("conv_id") - F.col("conv_id") % 5, head, most=8))
    assert collected(nodes) == brute(convs)


def test_nothing(spark):
    for turns in ([], [(None, 1, "user", "x")]):
        found = prefix_trie.digests(spark.createDataFrame(rows_of(turns), SCHEMA))
        assert prefix_trie.trie(found, found.select("conv_id").distinct()).collect() == []


def test_runs_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    ends = spark.createDataFrame([(bytes([k]), i) for k in (1, 2) for i in range(10 * k)], "key binary, conv_id bigint")
    got = {bytes(r.key)[0]: r.ends_sha256 for r in prefix_trie.ends_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(10 * k))).encode()).hexdigest() for k in (1, 2)}


@pytest.mark.parametrize("seed", range(6))
def test_decompose(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 50, 400])
    shape = rng.choice(["path", "star", "random"])
    parent = [-1] + [{"path": i - 1, "star": 0, "random": rng.randrange(-1, i)}[shape] for i in range(1, n)]
    depth, weight, values = [0] * n, np.ones(n, np.int64), np.array([[rng.randrange(100), 1] for _ in range(n)])
    for i in range(n):
        depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
    want = values.copy()
    for i in reversed(range(n)):
        if parent[i] >= 0:
            weight[parent[i]] += weight[i]
            want[parent[i]] += want[i]
    order = rng.sample(range(n), n)
    place = {x: i for i, x in enumerate(order)}
    up = np.array([place[parent[x]] if parent[x] >= 0 else -1 for x in order])
    got = prefix_trie.decompose(up, np.array(depth)[order], weight[order], values[order])
    assert got.tolist() == want[order].tolist()
