"""The prefix trie of conversations, with sums over subtrees by centroid decomposition.

A node is a distinct sequence of first turns.  It is named by a digest of its
depth and of two sums of hashes of (place, turn), which are running totals: a
conversation of any length is dealt over many tasks, and a node's parent is named
by the sums without its last turn, so no join finds it.

Sums over subtrees come from decomposing the forest of parent edges.  Each
component has a weight, the turns of all conversations on its nodes.  Its
centroid is the deepest node with at least half of the weight below it: without
it, what lies above and each child's part weigh at most half.  One round, for all
components at once,

* finds the centroids,
* totals what each has below it in its component; the total is part of the
  centroid's own sum and of all nodes on the path from it to the component's top,
* lowers the weights on that path, and
* parts the component there.

After log2(weight) rounds nothing would be left; components of at most ``LOCAL``
turns are finished by the same steps inside a task, many at a time.  The number
of rounds, and the work in each, do not depend on the depth or the width of the
trie, and one component, key or node is never one task's work.

Null role or text is empty; turns of a conversation with the same number are
ordered by digest; rows without a conv_id belong to no conversation.  Equal rows
are separate turns.  No conversation gives no node, not even the root.  Texts are
only hashed and measured, and do not travel.  Of the columns only the four of a
turn are read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweave.llm.store import discard, materialize, sent
from signalweave.operators.running import running

#: Weight of a component up to which one task finishes it.
LOCAL = 50_000
#: Nodes that a task works on at a time, at most by one component more.
CHUNK = 100_000
#: Ids that are joined to one string before they meet the rest of their node's.
RUN = 4096


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn_digest, n_bytes: the turns of each conversation in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", digest.alias("turn_digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    numbered = running(turns, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("turn_digest")], {"place": F.lit(1)}, lambda df: materialize(df, "turns"))
    return numbered.select("conv_id", (F.col("place") - 1).alias("place"), "turn_digest", "n_bytes")


def branched(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: (turns, conversations).

    ``base`` and ``head`` are expressions of conv_id: whose first turns, and how
    many of them, up to ``most``.  A conversation keeps its own turns after its
    first ``head``.  The second result has a row for each conversation, those that
    keep no turn included.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = own.select("conv_id", base.alias("base"), head.cast("bigint").alias("head"))
    there = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = materialize(convs.join(there, "base", "left").withColumn("got", F.least("head", F.coalesce("n_base", F.lit(0)))).select("conv_id", "base", "head", "got"), "branches")
    first = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "head"), "base").where(F.col("place") < F.col("head"))
    rest = turns.join(convs.select("conv_id", "head", "got"), "conv_id").where(F.col("place") >= F.col("head")).withColumn("place", F.col("got") + F.col("place") - F.col("head"))
    columns = ["conv_id", "place", "turn_digest", "n_bytes"]
    return first.select(*columns).unionByName(rest.select(*columns)), convs.select("conv_id")


def _name(depth: Column, *sums: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, n_bytes, len: the nodes of each conversation's path, the root included."""
    hashed = turns.select("conv_id", "place", "n_bytes", *[F.xxhash64(F.lit(i), "place", "turn_digest").cast("decimal(20,0)").alias(f"h{i}") for i in (1, 2)])
    summed = running(hashed, ["conv_id"], ["place"], {"s1": F.col("h1"), "s2": F.col("h2")}, lambda df: materialize(df, "prefixes"))
    depth = F.col("place") + 1
    steps = summed.select("conv_id", depth.alias("depth"), _name(depth, F.col("s1"), F.col("s2")).alias("key"), _name(F.col("place"), F.col("s1") - F.col("h1"), F.col("s2") - F.col("h2")).alias("parent"), "n_bytes")
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"))
    known = convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("len", F.lit(0)).alias("len"))
    zero = F.lit(0).cast("bigint")
    roots = known.select("conv_id", zero.alias("depth"), _name(zero, zero, zero).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("n_bytes"), "len")
    return materialize(steps.join(known, "conv_id").unionByName(roots), "paths")


def ends_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the decimal conv_ids of each key, ascending, joined by commas.

    Ids are joined to runs where they are sorted, over all tasks; a key's runs then
    pass through one digest, which never holds more than a batch of them.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at] and to - at < RUN:
                    to += 1
                out.append((keys[at], ids[at], ",".join(map(str, ids[at:to]))))
                at = to
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["key", "first", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, sums = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if digest is not None:
                        keys.append(key)
                        sums.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], names=["key", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    dealt = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = dealt.mapInArrow(runs, "key binary, first bigint, ids string").repartition("key").sortWithinPartitions("key", "first")
    return found.mapInArrow(joined, "key binary, ends_sha256 string")


def decompose(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over subtrees of a forest, by centroid decomposition.

    ``parent`` is a node's place or -1, ``weight`` what lies below it, itself
    included and at least 1 by itself; ``values`` has a column for each sum.
    """
    n = len(parent)
    out, weight = np.zeros_like(values), weight.copy()
    component = np.arange(n)
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(depth[order]) > 0]))
    for level in np.split(order, cuts[1:]) if n else []:
        inner = level[parent[level] >= 0]
        component[inner] = component[parent[inner]]
    gone = np.zeros(n, bool)
    alive = order  # by depth
    while len(alive):
        heavy = alive[2 * weight[alive] >= weight[component[alive]]]
        centroid = np.full(n, -1)
        centroid[component[heavy]] = heavy  # the deepest comes last
        chosen = np.unique(centroid[component[alive]])
        is_chosen = np.zeros(n, bool)
        is_chosen[chosen] = True
        below, renamed = is_chosen.copy(), component.copy()
        for level in np.split(alive, np.flatnonzero(np.diff(depth[alive]) > 0) + 1):
            up = parent[level]
            same = (up >= 0) & ~gone[up] & (component[up] == component[level])
            inner, up = level[same], up[same]
            below[inner] |= below[up]
            top = is_chosen[up]
            renamed[inner] = np.where(top, inner, renamed[up])
        under = alive[below[alive]]
        total = np.zeros_like(values)  # by component
        np.add.at(total, component[under], values[under])
        out[chosen] += total[component[chosen]]
        at, of = chosen, chosen
        while len(at):
            up = parent[at]
            go = (up >= 0) & ~gone[up] & (component[up] == component[of])
            at, of = up[go], of[go]
            out[at] += total[component[of]]
            weight[at] -= weight[of]
        gone[chosen] = True
        component = renamed
        alive = alive[~gone[alive]]
    return out


def _finish(parts: DataFrame, n_values: int) -> DataFrame:
    """(key, t0, t1, ...): sums over the subtrees of whole components, beside what they already have."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        keys, parents = rows.column("key").to_pylist(), rows.column("parent").to_pylist()
        place = {k: i for i, k in enumerate(keys)}
        up = np.array([place.get(p, -1) for p in parents], np.int64)
        component = rows.column("component").to_pylist()
        up[[i for i, u in enumerate(up.tolist()) if u >= 0 and component[u] != component[i]]] = -1
        numbers = {c: rows.column(c).to_numpy() for c in rows.column_names if c not in ("key", "parent", "component")}
        values = np.stack([numbers[f"v{i}"] for i in range(n_values)], axis=1)
        sums = decompose(up, numbers["depth"], numbers["weight"], values)
        return pa.RecordBatch.from_arrays([rows.column("key").combine_chunks(), *[pa.array(sums[:, i] + numbers[f"t{i}"], pa.int64()) for i in range(n_values)]], names=["key", *[f"t{i}" for i in range(n_values)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            last, component = rows.num_rows - 1, rows.column("component")
            end = component[last].as_py()
            while last > 0 and component[last - 1].as_py() == end:
                last -= 1  # the last component may go on in the next batch
            held = rows.slice(last).to_batches()
            if last:
                yield solve(rows.slice(0, last).combine_chunks())
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    names = ["component", "key", "parent", "depth", "weight", *[f"v{i}" for i in range(n_values)], *[f"t{i}" for i in range(n_values)]]
    dealt = parts.select(*names).repartition("component").sortWithinPartitions("component")
    return dealt.mapInArrow(run, "key binary, " + ", ".join(f"t{i} bigint" for i in range(n_values)))


def subtree_sums(nodes: DataFrame, on_paths: DataFrame, values: dict[str, Column], local: int = LOCAL) -> DataFrame:
    """key and, for each of ``values``, its sum over the node's subtree.

    ``nodes``: key, parent (null: a root), depth, conv_id, weight, where conv_id is
    one conversation through the node that goes through all nodes of its own
    subtree that have the same one, as the smallest does, and weight is the number
    of turns below, the node's own included.  ``on_paths``: conv_id, depth, key,
    parent.
    """
    n = len(values)
    state = nodes.select("key", "parent", "depth", "conv_id", "weight", *[v.cast("bigint").alias(f"v{i}") for i, v in enumerate(values.values())], *[F.lit(0).cast("bigint").alias(f"t{i}") for i in range(n)])
    root = nodes.where(F.col("parent").isNull()).select("key")
    roots = [r["key"] for r in root.limit(2).collect()]
    if len(roots) > 1:
        raise ValueError("a trie has one root")
    # One component to begin with: the whole trie.
    state = materialize(state.withColumn("component", F.lit(bytes(roots[0]) if roots else b"")), "trie")
    light, centroids = [], []
    while True:
        large = materialize(state.groupBy("component").agg(F.max("weight").alias("all")).where(F.col("all") > local), "components")
        light.append(state.join(sent(large.select("component")), "component", "left_anti"))
        open_ = state.join(sent(large), "component")
        heavy = open_.where(2 * F.col("weight") >= F.col("all"))
        best = heavy.groupBy("component").agg(F.max_by(F.struct("key", "conv_id", "depth", "weight"), "depth").alias("c"))
        cuts = materialize(best.select("component", F.col("c.key").alias("c_key"), F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids")
        if cuts.isEmpty():
            break
        # Conversations that go on below a centroid, with the child that they go through.
        through = on_paths.select("conv_id", F.col("key").alias("child"), "parent").join(sent(cuts), F.col("parent") == F.col("c_key")).select(F.col("component").alias("k_comp"), F.col("conv_id").alias("k_conv"), "child")
        above = on_paths.select("conv_id", "depth", "key").join(sent(cuts), (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") < F.col("c_depth"))).select(F.col("component").alias("u_comp"), F.col("key").alias("u_key"))
        marked = open_.drop("all").join(sent(cuts), "component")
        marked = marked.join(through, (F.col("component") == F.col("k_comp")) & (F.col("conv_id") == F.col("k_conv")) & (F.col("depth") > F.col("c_depth")), "left")
        marked = marked.join(above, (F.col("component") == F.col("u_comp")) & (F.col("key") == F.col("u_key")), "left")
        marked = materialize(marked.withColumns({"chosen": F.col("key") == F.col("c_key"), "up": F.col("u_key").isNotNull()}).drop("k_comp", "k_conv", "u_comp", "u_key"), "marked")
        totals = marked.where(F.col("chosen") | F.col("child").isNotNull()).groupBy("component").agg(*[F.sum(f"v{i}").alias(f"a{i}") for i in range(n)])
        given = marked.join(sent(materialize(totals, "totals")), "component")
        adds = F.col("chosen") | F.col("up")
        given = given.withColumns({f"t{i}": F.col(f"t{i}") + F.when(adds, F.col(f"a{i}")).otherwise(0) for i in range(n)})
        given = given.withColumn("weight", F.col("weight") - F.when(F.col("up"), F.col("c_weight")).otherwise(0)).withColumn("component", F.coalesce("child", "component"))
        given = materialize(given.select(*state.columns, "chosen"), "trie")
        discard(marked)
        centroids.append(given.where("chosen").select("key", *[f"t{i}" for i in range(n)]))
        state = given.where(~F.col("chosen")).drop("chosen")
    parts = light[0]
    for p in light[1:]:
        parts = parts.unionByName(p)
    found = _finish(parts, n)
    for c in centroids:
        found = found.unionByName(c)
    return found.select("key", *[F.col(f"t{i}").alias(name) for i, name in enumerate(values)])


def trie(turns: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """A row for each node: key, conv_id (the smallest member), depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, place, turn_digest, n_bytes; ``convs``: conv_id, also of
    conversations without a turn.  ``saved_tokens`` sums (n_convs - 1) * n_bytes
    over the subtree, ``n_leaves`` the childless nodes in it.
    """
    on_paths = paths(turns, convs)
    own = on_paths.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    own = materialize(own, "nodes")
    children = own.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = own.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = materialize(own.join(children, "key", "left").fillna(0, ["n_children"]).join(parents, "parent", "left"), "nodes")
    sums = subtree_sums(nodes, on_paths, {"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}, local)
    ends = ends_digests(on_paths.where(F.col("depth") == F.col("len")))
    none = hashlib.sha256(b"").hexdigest()
    found = nodes.join(sums, "key").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    return found.select("key", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM ids CROSS JOIN tab),
n AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
r AS (
  SELECT k.conv_id, 0 AS own, pos, role, text FROM k JOIN n ON n.conv_id = k.base AND pos < h
  UNION ALL SELECT k.conv_id, 1, pos, role, text FROM k JOIN n ON n.conv_id = k.conv_id AND pos >= h),
s AS (
  SELECT ids.conv_id, coalesce(seq, []) AS seq
  FROM ids LEFT JOIN (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY own, pos) AS seq FROM r GROUP BY conv_id) USING (conv_id)),
p AS (SELECT conv_id, d, seq[:d] AS pre, d = len(seq) AS ends FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
v AS (
  SELECT pre, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended
  FROM p GROUP BY pre),
c AS (SELECT pre[:depth - 1] AS pre, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
w AS (
  SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(pre[depth].text) END AS saved FROM v LEFT JOIN c USING (pre)),
u AS (
  SELECT pre[:e] AS pre, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT pre, n_children, saved, unnest(range(0, depth + 1)) AS e FROM w) GROUP BY ALL)
SELECT w.conv_id::BIGINT AS conv_id, w.depth::BIGINT AS depth, o.conv_id::BIGINT AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(w.ended) AS ends_sha256
FROM w JOIN u USING (pre) LEFT JOIN w o ON w.depth > 0 AND o.pre = w.pre[:w.depth - 1]
"""
