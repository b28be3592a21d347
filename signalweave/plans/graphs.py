"""Graph queries over parts: a part leads to the dearer part on the next line of an order, so dear parts lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalweave.operators import graph as G
from signalweave.operators import telemetry as T
from signalweave.registry import register, table
from signalweave.storage import cut

#: Where walks begin: a cheap part, and a dear one for what leads to it.
START, END = 3, 190
#: Links from which on a part is a hub.
HUB_MIN = 12

_EDGES = """
x AS (
  SELECT l_partkey AS p, p_retailprice AS price, lead(l_partkey) OVER w AS q, lead(p_retailprice) OVER w AS next_price
  FROM lineitem JOIN part ON l_partkey = p_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)),
e AS (SELECT DISTINCT p AS src, q AS dst FROM x WHERE next_price > price),
v AS (SELECT p_partkey AS node FROM part)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = lines.select(F.col("l_partkey").alias("src"), F.col("p_retailprice").alias("price"), F.lead("l_partkey").over(order).alias("dst"), F.lead("p_retailprice").over(order).alias("next_price"))
    return steps.where("next_price > price").select(F.lit("parts").alias("repo"), "src", "dst")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lit("parts").alias("repo"), F.col("p_partkey").alias("node"))


@register("graph_edges", f"WITH {_EDGES} SELECT src, dst FROM e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_edges(edges(spark, sf_dir)).select("src", "dst")


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links, worked out once for all that reads them."""
    return cut(G.build_edges(edges(spark, sf_dir)))


_LINKS = f"WITH RECURSIVE {_EDGES}, o AS (SELECT src, count(*) AS n FROM e GROUP BY src), link AS (SELECT e.src, e.dst, 1.0::DOUBLE / o.n AS w FROM e JOIN o USING (src))"


def _ranks(name: str, teleport: str, iters: int, own: float) -> str:
    """Rounds of ranks over ``link`` as a common table of that name, from the teleport shares that a query gives."""
    return f""",
t_{name} AS ({teleport}),
{name}(i, node, rank) AS (
  SELECT 0, node, t FROM t_{name}
  UNION ALL
  SELECT s.i + 1, r.node, 0.15 * t.t + 0.85 * (coalesce(g.given, 0) * {1 - own} + {own} * r.rank + s.loose * {1 - own} * t.t)
  FROM {name} r JOIN t_{name} t ON t.node = r.node
  CROSS JOIN (SELECT max(i) AS i, coalesce(sum(rank) FILTER (node NOT IN (SELECT src FROM e)), 0) AS loose FROM {name}) s
  LEFT JOIN (SELECT l.dst, sum(q.rank * l.w) AS given FROM {name} q JOIN link l ON l.src = q.node GROUP BY l.dst) g ON g.dst = r.node
  WHERE s.i < {iters})
"""


_RANK = _LINKS + _ranks("p", "SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM v) AS t FROM v", 40, 0.0)


def _personal(weight: int) -> str:
    each = f"CASE WHEN node = {START} THEN {weight} ELSE 1 END"
    return _ranks(f"p{weight}", f"SELECT node, ({each})::DOUBLE / (SELECT sum({each}) FROM v) AS t FROM v", 50, 0.1)


@register("pagerank", _RANK + "SELECT node, round(rank, 9) AS rank FROM p WHERE i = 40")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(nodes(spark, sf_dir), linked(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


@register("node_stats", _RANK + """,
a AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY ALL), b AS (SELECT src AS node, count(*) AS n FROM e GROUP BY ALL)
SELECT p.node, round(p.rank, 9) AS rank, coalesce(a.n, 0) AS in_deg, coalesce(b.n, 0) AS out_deg
FROM p LEFT JOIN a USING (node) LEFT JOIN b USING (node) WHERE i = 40""")
def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = nodes(spark, sf_dir), linked(spark, sf_dir)
    return G.node_stats(v, e, G.pagerank(v, e)).select("node", F.round("rank", 9).alias("rank"), "in_deg", "out_deg")


@register("personalized_pagerank", _LINKS + _personal(50) + " SELECT node, round(rank, 9) AS rank FROM p50 WHERE i = 50")
def personalized_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = nodes(spark, sf_dir)
    return G.personalized_pagerank(v, linked(spark, sf_dir), v.where(F.col("node") == START).withColumn("weight", F.lit(50.0))).select("node", F.round("rank", 9).alias("rank"))


@register("task_neighbors", _LINKS + _personal(50) + _personal(1) + f""",
n AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
h AS (SELECT b AS node FROM n WHERE a = {START} UNION SELECT y.b FROM n x JOIN n y ON y.a = x.b WHERE x.a = {START}),
f AS (SELECT node, p50.rank / p1.rank AS lift FROM p50 JOIN p1 USING (node) JOIN h USING (node) WHERE p50.i = 50 AND p1.i = 50 AND node <> {START})
SELECT node, round(lift, 6) AS lift FROM f WHERE lift >= 1.0 ORDER BY lift DESC, node LIMIT 3""")
def task_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = nodes(spark, sf_dir), linked(spark, sf_dir)
    # Both rankings in one run of rounds, as two repos over the same links.
    kinds = F.explode(F.array(F.lit("personal"), F.lit("overall")))
    twice = [x.withColumn("repo", kinds) for x in (v, e)]
    seed = twice[0].where(F.col("node") == START).withColumn("weight", F.when(F.col("repo") == "personal", 50.0).otherwise(1.0))
    ranks = G.personalized_pagerank(*twice, seed)
    personal, overall = (ranks.where(F.col("repo") == k).withColumn("repo", F.lit("parts")) for k in ("personal", "overall"))
    return G.task_neighbors(personal, overall, G.khop(e, v.where(F.col("node") == START), 2), min_lift=1.0).select("node", F.round("lift", 6).alias("lift"))


@register("personalized_top", _LINKS + _personal(50) + f"""
SELECT node, round(rank, 9) AS rank FROM p50 WHERE i = 50 AND node <> {START} AND node NOT IN (SELECT dst FROM e WHERE src = {START}) ORDER BY p50.rank DESC, node LIMIT 5""")
def personalized_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is near a part without being its neighbour."""
    v, e = nodes(spark, sf_dir), linked(spark, sf_dir)
    seeds = v.where(F.col("node") == START).withColumn("weight", F.lit(50.0))
    known = e.where(F.col("src") == START).select("repo", F.col("dst").alias("node"))
    return G.personalized_top(G.personalized_pagerank(v, e, seeds), seeds, known, 5).select("node", F.round("rank", 9).alias("rank"))


def _reach_sql(step: str, hops: int, start: int) -> str:
    return f"""
WITH RECURSIVE {_EDGES}, st AS ({step}),
w(node, level) AS (SELECT {start}, 0 UNION SELECT st.b, w.level + 1 FROM w JOIN st ON st.a = w.node WHERE w.level < {hops}),
m AS (SELECT node, min(level)::INT AS level FROM w GROUP BY node HAVING min(level) > 0)
"""


@register("khop", _reach_sql("SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e", 2, START) + "SELECT node FROM m")
def khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.khop(edges(spark, sf_dir), nodes(spark, sf_dir).where(F.col("node") == START), 2).select("node")


@register("blast_radius", _reach_sql("SELECT dst AS a, src AS b FROM e", 5, END) + "SELECT node, level FROM m")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blast_radius(edges(spark, sf_dir), nodes(spark, sf_dir).where(F.col("node") == END), 5).select("node", "level")


@register("rank_tiers", _RANK + """
, q AS (SELECT node, rank, row_number() OVER (ORDER BY round(rank, 9) DESC, node) - 1 AS place, count(*) OVER () AS n FROM p WHERE i = 40)
SELECT node, place::INT AS place, CASE WHEN place / n <= 0.05 THEN 'core' WHEN place / n <= 0.2 THEN 'major' WHEN place / n <= 0.5 THEN 'common' ELSE 'edge' END AS level FROM q""")
def rank_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = G.pagerank(nodes(spark, sf_dir), linked(spark, sf_dir)).withColumn("rank", F.round("rank", 9))
    return T.rank_tiers(ranks).select("node", F.col("place").cast("int").alias("place"), "level")


@register("segment_map", _RANK + """
, q AS (SELECT p.node, round(rank, 9) AS rank, p_brand AS segment FROM p JOIN part ON p_partkey = node WHERE i = 40),
t AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY rank DESC, node) AS k FROM q)
SELECT segment, round(sum(rank), 6) AS total_rank, count(*) AS nodes, array_to_string(list(node ORDER BY k) FILTER (k <= 3), ',') AS top FROM t GROUP BY segment ORDER BY sum(rank) DESC, segment LIMIT 10""")
def segment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = G.pagerank(nodes(spark, sf_dir), linked(spark, sf_dir)).withColumn("rank", F.round("rank", 9))
    placed = ranks.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("segment")), "node")
    top = T.segment_map(placed)
    return top.select("segment", F.round("total_rank", 6).alias("total_rank"), "nodes", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


@register("graph_export", _RANK + """
, t AS (SELECT node, round(rank, 9) AS rank FROM p WHERE i = 40 ORDER BY p.rank DESC, node LIMIT 40)
SELECT src, dst, x.rank AS src_rank, y.rank AS dst_rank FROM e JOIN t x ON x.node = src JOIN t y ON y.node = dst""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between the 40 parts of highest rank."""
    v, e = nodes(spark, sf_dir), linked(spark, sf_dir)
    top, kept = G.export_graph(G.node_stats(v, e, G.pagerank(v, e)), e, 40)
    rank = lambda end: top.select(F.col("node").alias(end), F.round("rank", 9).alias(f"{end}_rank"))
    return kept.join(rank("src"), "src").join(rank("dst"), "dst").select("src", "dst", "src_rank", "dst_rank")


@register("content_reach", f"""
WITH RECURSIVE {_EDGES},
a AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY ALL), b AS (SELECT src AS node, count(*) AS n FROM e GROUP BY ALL),
h AS (SELECT v.node, coalesce(a.n, 0) AS in_deg, coalesce(b.n, 0) AS out_deg, coalesce(b.n, 0) >= {HUB_MIN} AS is_hub FROM v LEFT JOIN a USING (node) LEFT JOIN b USING (node)),
w(node, level) AS (SELECT node, 0 FROM h WHERE is_hub UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node),
m AS (SELECT node, min(level)::INT AS depth FROM w GROUP BY node)
SELECT h.node, in_deg, out_deg, is_hub, depth, in_deg = 0 AND NOT is_hub AS orphan,
       (SELECT bool_or(is_hub) FROM h) AND depth IS NULL AND NOT (in_deg = 0 AND NOT is_hub) AS unreachable FROM h LEFT JOIN m USING (node)""")
def content_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.content_reach(nodes(spark, sf_dir), G.build_edges(edges(spark, sf_dir)), HUB_MIN).drop("repo")


@register("link_components", f"""
WITH RECURSIVE {_EDGES},
l AS (SELECT src AS a, dst AS b FROM e WHERE src % 40 = dst % 40), n AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, reached) AS (SELECT a, a FROM n UNION SELECT r.node, n.b FROM r JOIN n ON n.a = r.reached)
SELECT node, min(reached) AS component FROM r GROUP BY node""")
def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of parts that links within one of 40 classes tie together."""
    e = G.build_edges(edges(spark, sf_dir)).where("src % 40 = dst % 40")
    return G.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
