"""Queries over order lines read as change history: an order is a commit, a part a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.operators import history
from signalweave.registry import register, table

MAX_PER_COMMIT = 30


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.lit("tpch").alias("repo"), F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"))


_FILES = f"""
WITH f AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem),
g AS (SELECT sha, path FROM f WHERE sha IN (SELECT sha FROM f GROUP BY sha HAVING count(*) <= {MAX_PER_COMMIT})),
p AS (SELECT x.path AS a, y.path AS b, count(*) AS n FROM g x JOIN g y ON x.sha = y.sha AND x.path < y.path GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT path AS file, count(*) AS n FROM g GROUP BY ALL)
"""


@register("cochange_pairs", _FILES + "SELECT 'tpch' AS repo, a, b, n FROM p")
def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cochange(commit_files(spark, sf_dir), MAX_PER_COMMIT)


@register("cochange_totals", _FILES + "SELECT 'tpch' AS repo, file, n FROM t")
def cochange_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cochange_totals(commit_files(spark, sf_dir), MAX_PER_COMMIT)


@register("cochange_partners", _FILES + """,
s AS (SELECT a AS file, b AS partner, n FROM p UNION ALL SELECT b, a, n FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, partner) AS k FROM s)
SELECT 'tpch' AS repo, r.file, partner, r.n, r.n / t.n AS share FROM r JOIN t USING (file) WHERE k <= 10""")
def cochange_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = commit_files(spark, sf_dir)
    return history.partners(history.cochange(files, MAX_PER_COMMIT), history.cochange_totals(files, MAX_PER_COMMIT))
