"""Operators on link graphs: (repo, src, dst) edges and (repo, node) nodes.

Ranks are worked out in rounds over a table of links that is dealt out once, in
blocks of nodes, and stays where it is: a round sends each block's ranks to its
links' tasks and the sums for other blocks on to these.  The links of a block with
many are dealt in parts.  A round ends with the ranks, not the links, written to
the folder that all executors share, so a lost executor costs one round at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalweave.storage import cut as _cut
from signalweave.storage import discard as _discard
from signalweave.storage import written as _written


def build_edges(links: DataFrame) -> DataFrame:
    """Distinct edges without self-loops."""
    return links.select("repo", "src", "dst").where(F.col("src") != F.col("dst")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("repo", F.explode(F.array("src", "dst")).alias("node")).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iters: int = 40) -> DataFrame:
    """(repo, node, rank): uniform start, dangling mass spread evenly, ranks of a repo sum to 1."""
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("_n"))
    teleport = nodes.join(n, "repo").select("repo", "node", (1.0 / F.col("_n")).alias("_t"))
    return _ranked(teleport, edges, damping, iters, 0.0)


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iters: int = 50, self_loop: float = 0.1) -> DataFrame:
    """(repo, node, rank) with teleport in proportion to seed weights; a node that is no seed weighs 1.

    ``seeds``: repo, node, weight.  Each node keeps ``self_loop`` of what it
    passes on, and a node without links passes its mass to the teleport.
    """
    weighted = nodes.join(seeds.select("repo", "node", "weight"), ["repo", "node"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    total = weighted.groupBy("repo").agg(F.sum("weight").alias("_sum"))
    teleport = weighted.join(total, "repo").select("repo", "node", (F.col("weight") / F.col("_sum")).alias("_t"))
    return _ranked(teleport, edges, damping, iters, self_loop)


#: Nodes of a block, whose ranks are one array.
WIDTH = 1 << 16
#: Links of a block that one row holds.
HUB = 2_000_000
#: Repos up to which what is summed for each of them is sent to all tasks.
SENT_REPOS = 1_000_000


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of arrays."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[lo:hi] for lo, hi in itertools.pairwise(ends.tolist())]


def _packed(rows: DataFrame, keys: list[str], columns: dict[str, str], order: tuple[str, ...]) -> DataFrame:
    """One row for each value of the keys, with the ``columns`` (name: type) as arrays sorted by ``order``."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*keys, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            values = {c: whole[c].to_numpy() for c in columns}
            by = np.lexsort([values[c] for c in reversed(order)])
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(by)], pa.int32()), pa.array(values[c][by])) for c in columns]
            return pa.RecordBatch.from_arrays([*[held[0].column(k).slice(0, 1) for k in keys], *arrays], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                at |= pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(at) + 1).tolist(), batch.num_rows]
            for lo, hi in itertools.pairwise(cuts):
                part = batch.slice(lo, hi - lo)
                if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                    yield told()
                    held = []
                held.append(part)
        if held:
            yield told()

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"{c} array<{t}>" for c, t in columns.items()]])
    dealt = rows.select(names).repartition(*keys).sortWithinPartitions(*reversed(keys))
    return dealt.mapInArrow(run, schema)


def _ranked(teleport: DataFrame, edges: DataFrame, damping: float, iters: int, self_loop: float) -> DataFrame:
    """(repo, node, rank) after ``iters`` rounds from the teleport shares ``_t``.

    The nodes of a repo are dealt to blocks by hash and numbered there, so that the
    ranks of a block are one array and its links two.  A round sums what a block
    gives to each other block and sends these sums, not a row for every link.  The
    mass of nodes without links, summed for each repo, goes to the teleport.
    ``edges`` are read twice.
    """
    degrees = edges.groupBy("repo", F.col("src").alias("node")).agg(F.count(F.lit(1)).cast("int").alias("_deg"))
    sizes = _cut(teleport.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / WIDTH).cast("int").alias("_blocks")))
    few = sizes.count() <= SENT_REPOS
    by_repo = lambda df: F.broadcast(df) if few else df
    dealt = teleport.join(degrees, ["repo", "node"], "left").join(by_repo(sizes), "repo")
    dealt = dealt.select("repo", "node", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int").alias("block"), "_t", F.coalesce("_deg", F.lit(0)).alias("_deg"))
    slot = F.row_number().over(Window.partitionBy("repo", "block").orderBy("node")) - 1
    base = _cut(dealt.withColumn("slot", slot))
    parts = base.groupBy("repo", "block").agg(F.ceil(F.sum("_deg") / HUB).cast("int").alias("parts"))

    source = base.where("_deg > 0").join(parts, ["repo", "block"]).select("repo", F.col("node").alias("src"), "block", "slot", "parts")
    target = base.select("repo", F.col("node").alias("dst"), F.col("block").alias("to"), F.col("slot").alias("at"))
    placed = edges.select("repo", "src", "dst").join(source, ["repo", "src"]).join(target, ["repo", "dst"])
    placed = placed.select("repo", "block", F.pmod(F.xxhash64("to", "at"), F.col("parts")).cast("int").alias("part"), "slot", "to", "at")
    packed = _cut(_packed(placed, ["repo", "block", "part"], {"slot": "int", "to": "int", "at": "int"}, ("to", "at")))
    links = packed.repartition("repo", "block", "part").persist()
    arrays = _packed(base, ["repo", "block"], {"slot": "int", "_t": "double", "_deg": "int"}, ("slot",))
    loose = F.aggregate(F.arrays_zip("_t", "_deg"), F.lit(0.0), lambda s, x: s + F.when(x["_deg"] == 0, x["_t"]).otherwise(0.0))
    state = _cut(arrays.join(parts, ["repo", "block"]).select("repo", "block", "parts", F.col("_t").alias("t"), F.col("_deg").alias("deg"), F.col("_t").alias("rank"), loose.alias("loose")))
    repo = base.schema["repo"].dataType.simpleString()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (slot, to, at, rank, deg) in enumerate(zip(*[_lists(batch.column(c)) for c in range(1, 6)], strict=True)):
                share = (1 - self_loop) * rank / np.maximum(deg, 1)
                fresh = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (at[1:] != at[:-1])]))
                sums, to, at = np.add.reduceat(share[slot], fresh), to[fresh], at[fresh]
                starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                ends = pa.array(np.append(starts, len(to)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at, sums)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(starts), i))), pa.array(to[starts]), *lists], names=["repo", "block", "at", "sums"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["repo", "block", "parts", "t", "deg", "rank", "loose"]
        now, total = None, np.empty(0)

        def told() -> pa.RecordBatch:
            row, t, deg, rank, pool = now
            new = (1 - damping) * t + damping * (total + self_loop * rank + (1 - self_loop) * pool * t)
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.array(x)) for x in (t, deg, new)]
            return pa.RecordBatch.from_arrays([*row, *arrays, pa.array([float(new[deg == 0].sum())])], names=names)

        for batch in batches:
            held = [_lists(batch.column(c)) for c in ("t", "deg", "rank", "at", "sums")]
            for i, (own, pool) in enumerate(zip(batch.column("own").to_pylist(), batch.column("pool").to_pylist(), strict=True)):
                if own:
                    if now is not None:
                        yield told()
                    t, deg, rank = (held[c][i].copy() for c in range(3))
                    now, total = ([batch.column(c).slice(i, 1) for c in ("repo", "block", "parts")], t, deg, rank, pool), np.zeros(len(t))
                else:
                    total[held[3][i]] += held[4][i]
        if now is not None:
            yield told()

    try:
        for _ in range(iters):
            pool = state.groupBy("repo").agg(F.sum("loose").alias("pool"))
            shares = state.where("parts > 0").select("repo", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rank", "deg")
            given = links.join(shares, ["repo", "block", "part"]).select("repo", "slot", "to", "at", "rank", "deg").mapInArrow(give, f"repo {repo}, block int, at array<int>, sums array<double>")
            owned = state.drop("loose").join(by_repo(pool), "repo").withColumn("own", F.lit(True))
            both = owned.unionByName(given.withColumn("own", F.lit(False)), allowMissingColumns=True)
            dealt = both.repartition("repo", "block").sortWithinPartitions("block", "repo", F.desc("own"))
            before, state = state, _written(dealt.mapInArrow(take, f"repo {repo}, block int, parts int, t array<double>, deg array<int>, rank array<double>, loose double"))
            _discard(before)
    finally:
        links.unpersist()
    ranks = state.select("repo", "block", F.posexplode("rank").alias("slot", "rank"))
    return base.select("repo", "block", "slot", "node").join(ranks, ["repo", "block", "slot"]).select("repo", "node", "rank")


def task_neighbors(personal: DataFrame, overall: DataFrame, hood: DataFrame, k: int = 3, min_lift: float = 1.3) -> DataFrame:
    """(repo, node, lift): nodes of a neighbourhood whose personal rank exceeds the overall one, the k highest."""
    joined = personal.join(overall.withColumnRenamed("rank", "_overall"), ["repo", "node"]).join(hood.select("repo", "node").distinct(), ["repo", "node"], "left_semi")
    lifted = joined.select("repo", "node", F.try_divide("rank", "_overall").alias("lift")).where(F.col("lift") >= min_lift)
    top = Window.partitionBy("repo").orderBy(F.desc("lift"), "node")
    return lifted.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k).drop("_r")


def personalized_top(personal: DataFrame, seeds: DataFrame, exclude: DataFrame, k: int) -> DataFrame:
    """The k nodes of highest personal rank that are neither seeds nor excluded."""
    rest = personal.join(seeds.select("repo", "node"), ["repo", "node"], "left_anti").join(exclude.select("repo", "node"), ["repo", "node"], "left_anti")
    top = Window.partitionBy("repo").orderBy(F.desc("rank"), "node")
    return rest.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k).drop("_r")


#: Nodes that are sent to all links, which then are not shuffled.
SENT_FRONT = 100_000


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None, undirected: bool = False, reverse: bool = False) -> DataFrame:
    """(repo, node, level): the fewest hops from a seed, seeds at level 0; breadth-first, one join a level, without ``hops`` until nothing is new."""
    step = edges.select("repo", F.col("src").alias("_from"), F.col("dst").alias("node"))
    back = edges.select("repo", F.col("dst").alias("_from"), F.col("src").alias("node"))
    step = step.unionByName(back) if undirected else back if reverse else step
    step = _cut(step)
    seen = _cut(seeds.select("repo", "node").distinct().withColumn("level", F.lit(0)))
    front, known = seen, seen.count()
    for level in itertools.count(1):
        if hops is not None and level > hops:
            break
        start = front.select("repo", F.col("node").alias("_from"))
        new = step.join(F.broadcast(start) if known <= SENT_FRONT else start, ["repo", "_from"]).select("repo", "node").distinct()
        front = _cut(new.join(seen, ["repo", "node"], "left_anti").withColumn("level", F.lit(level)))
        known = front.count()
        if not known:
            break
        seen = seen.unionByName(front)
        if level % 10 == 0:
            seen = _cut(seen)
    return seen


def khop(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(repo, node): within so many hops of a seed in either direction, seeds left out."""
    return reach(edges, seeds, hops, undirected=True).where(F.col("level") > 0).select("repo", "node")


def blast_radius(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """(repo, node, level): what depends on the start, directly or through others."""
    return reach(edges, start, depth, reverse=True).where(F.col("level") > 0)


def node_stats(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(repo, node, rank, in_deg, out_deg)."""
    into = edges.groupBy("repo", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_deg"))
    out = edges.groupBy("repo", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_deg"))
    joined = nodes.join(ranks, ["repo", "node"], "left").join(into, ["repo", "node"], "left").join(out, ["repo", "node"], "left")
    return joined.select("repo", "node", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("in_deg", F.lit(0)).cast("bigint").alias("in_deg"), F.coalesce("out_deg", F.lit(0)).cast("bigint").alias("out_deg"))


def content_reach(nodes: DataFrame, edges: DataFrame, hub_min: int = 5) -> DataFrame:
    """(repo, node, in_deg, out_deg, is_hub, depth, orphan, unreachable).

    A hub links to ``hub_min`` others; an orphan is no hub and nothing links to
    it; unreachable is what no hub leads to, where there are hubs.
    """
    into = edges.groupBy("repo", F.col("dst").alias("node")).agg(F.count_distinct("src").alias("in_deg"))
    out = edges.groupBy("repo", F.col("src").alias("node")).agg(F.count_distinct("dst").alias("out_deg"))
    known = nodes.join(into, ["repo", "node"], "left").join(out, ["repo", "node"], "left").fillna(0, ["in_deg", "out_deg"])
    known = _cut(known.withColumn("is_hub", F.col("out_deg") >= hub_min))
    depth = reach(edges, known.where("is_hub"), None).withColumnRenamed("level", "depth")
    orphan = (F.col("in_deg") == 0) & ~F.col("is_hub")
    hubs = F.max("is_hub").over(Window.partitionBy("repo"))
    return known.join(depth, ["repo", "node"], "left").select("repo", "node", "in_deg", "out_deg", "is_hub", "depth", orphan.alias("orphan"), (hubs & F.col("depth").isNull() & ~orphan).alias("unreachable"))


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    kept = edges.join(nodes.select("repo", F.col("node").alias("src")).distinct(), ["repo", "src"], "left_semi")
    return kept.join(nodes.select("repo", F.col("node").alias("dst")).distinct(), ["repo", "dst"], "left_semi").select(edges.columns)


def export_graph(stats: DataFrame, edges: DataFrame, limit: int = 220) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest rank in each repo, and the edges between them."""
    top = Window.partitionBy("repo").orderBy(F.desc("rank"), "node")
    nodes = stats.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= limit).drop("_r")
    return nodes, drop_dangling(edges, nodes)


# ---- components ------------------------------------------------------------

#: Links that a task joins at once.
LOCAL_LINKS = 1_000_000


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) by the links that a task sees: union-find, ``LOCAL_LINKS`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        def told() -> pa.RecordBatch:
            nodes = list(up)
            out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])
            up.clear()
            return out

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > LOCAL_LINKS:
                yield told()
        if up:
            yield told()

    return links.mapInArrow(run, "node bigint, root bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the whole numbers in ``links`` (a, b): component is the smallest node reachable.

    Each round finds the roots of nodes task by task.  A node with several roots
    takes the least, and its other roots are linked with that one: these links go
    to the next round, which has far fewer of them.  The rounds end when no node
    has two roots.
    """
    levels, left = [], links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    while True:
        found = _cut(_roots(left).groupBy("node").agg(F.min("root").alias("least"), F.collect_set("root").alias("roots")))
        levels.append(found.select("node", "least"))
        many = found.where(F.size("roots") > 1)
        left = many.select(F.explode("roots").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
        n = many.agg(F.sum(F.size("roots") - 1)).first()[0]
        if not n:
            break
        # What a task joins at once is one round's work there; dealt out, a chain of roots would take a round for each link.
        left = left.repartition(1) if n <= LOCAL_LINKS else left.repartition("b")
    out = levels.pop()
    while levels:
        below = levels.pop()
        out = below.join(out.select(F.col("node").alias("least"), F.col("least").alias("_last")), "least", "left").select("node", F.coalesce("_last", "least").alias("least"))
    return _cut(out.withColumnRenamed("least", "component"))
