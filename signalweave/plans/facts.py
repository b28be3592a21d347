"""Journal queries: a supplier's share of returned lines is a fact, measured before a day and again over all lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.operators import journal
from signalweave.registry import register, table

SPLIT = "1995-01-20 00:00:00"
AT = "2030-01-01 00:00:00"


def return_facts(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """(repo, area, statement, prevalence, positive, total): suppliers by nation, the share in tenths."""
    lines = table(spark, sf_dir, "lineitem")
    if before is not None:
        lines = lines.where(F.col("l_shipdate") < F.lit(before).cast("timestamp_ntz"))
    returned = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    counts = lines.groupBy("l_suppkey").agg(returned.alias("positive"), F.count(F.lit(1)).alias("total"))
    nations = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    facts = counts.join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    tenths = F.expr("(10 * positive) div total").cast("string")
    return facts.select(
        F.col("s_nationkey").cast("string").alias("repo"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("area"),
        F.concat(F.lit("returned — "), tenths, F.lit(" of 10")).alias("statement"), (F.col("positive") / F.col("total")).alias("prevalence"), "positive", "total",
    )


_FACTS = """
SELECT s_nationkey::VARCHAR AS repo, 'supplier ' || s_suppkey AS area, count(*) FILTER (l_returnflag = 'R') AS positive, count(*) AS total,
  'returned — ' || ((10 * count(*) FILTER (l_returnflag = 'R')) // count(*)) || ' of 10' AS statement
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey {where} GROUP BY s_nationkey, s_suppkey"""
_BOTH = f"WITH old AS ({_FACTS.format(where=f"WHERE l_shipdate < TIMESTAMP '{SPLIT}'")}), new AS ({_FACTS.format(where='')})"


@register("journal_outcomes", _BOTH + """
SELECT repo, area, new.statement, new.total, CASE WHEN old.area IS NULL THEN 'born' WHEN old.statement = new.statement THEN 'confirmed' ELSE 'changed' END AS outcome
FROM new LEFT JOIN old USING (repo, area)
UNION ALL
SELECT repo, area, old.statement, old.total, 'superseded' FROM old JOIN new USING (repo, area) WHERE old.statement <> new.statement""")
def journal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty, now = spark.createDataFrame([], journal.JOURNAL), F.lit(AT).cast("timestamp")
    first = journal.assert_facts(empty, return_facts(spark, sf_dir, SPLIT), "lines", now).drop("outcome")
    return journal.assert_facts(first, return_facts(spark, sf_dir), "lines", now).select("repo", "area", "statement", "total", "outcome")


#: Instants of the two batches, and of looking back.
FIRST, SECOND, LATER = "2030-01-01 00:00:00", "2030-01-21 00:00:00", "2031-06-01 00:00:00"


def _twice(spark: SparkSession, sf_dir: str, modelled: bool) -> DataFrame:
    """The journal after both measurements, the second one twenty days later."""
    at = lambda t: F.lit(t).cast("timestamp")
    first = journal.assert_facts(spark.createDataFrame([], journal.JOURNAL), return_facts(spark, sf_dir, SPLIT), "lines", at(FIRST), modelled).drop("outcome")
    return journal.assert_facts(first, return_facts(spark, sf_dir), "lines", at(SECOND), modelled).drop("outcome")


def _rated(evidence: str) -> str:
    """Ratings of both measurements, from so much evidence, and what is in force after both."""
    return _BOTH + f""",
r AS (
  SELECT repo, area, statement, era, n, m, sqrt(m * (1 - m) / (n + 3)) AS d
  FROM (SELECT *, (n * p + 1) / (n + 2) AS m FROM (
    SELECT repo, area, statement, 0 AS era, {evidence} AS n, positive / total AS p FROM old UNION ALL SELECT repo, area, statement, 1, {evidence}, positive / total FROM new))),
live AS (
  SELECT b.repo, b.area, CASE WHEN a.statement = b.statement THEN 2 ELSE 1 END AS confirmations,
         CASE WHEN a.statement = b.statement THEN a.m + a.d * a.d / (a.d * a.d + b.d * b.d) * (b.m - a.m) ELSE b.m END AS rating,
         CASE WHEN a.statement = b.statement THEN a.d * b.d / sqrt(a.d * a.d + b.d * b.d) ELSE b.d END AS deviation
  FROM (SELECT * FROM r WHERE era = 1) b LEFT JOIN (SELECT * FROM r WHERE era = 0) a USING (repo, area))"""


@register("journal_ratings", _rated("total") + """
SELECT repo, area, confirmations, round(rating, 9) AS rating, round(deviation, 9) AS deviation, round(e, 9) AS effective_deviation,
       CASE WHEN rating - 1.64 * e >= 0.85 THEN 'law' WHEN rating - 1.64 * e >= 0.6 THEN 'habit' WHEN rating >= 0.5 THEN 'hypothesis' ELSE 'no_consensus' END AS live_tier
FROM (SELECT *, least(sqrt(deviation * deviation + 0.2 * 0.2 / 365 * 496), sqrt(1 / 12)) AS e FROM live)""")
def journal_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = journal.active_facts(_twice(spark, sf_dir, False), F.lit(LATER).cast("timestamp"))
    return active.select("repo", "area", F.col("confirmations").cast("int").alias("confirmations"), *[F.round(c, 9).alias(c) for c in ("rating", "deviation", "effective_deviation")], "live_tier")


@register("journal_reviews", _rated("4.0") + """,
s AS (
  SELECT repo, area, CASE WHEN confirmations = 1 THEN 14 ELSE least(365, 14 * (1 + exp(1.49) * 6 * pow(14, -0.14) * (exp(0.94 * (1 - pow(1 + 19 / 81 * 20 / 14, -0.5))) - 1))) END AS stability FROM live),
f AS (SELECT *, pow(1 + 19 / 81 * 496 / stability, -0.5) AS retrievability FROM s)
SELECT repo, area, round(stability, 6) AS stability, round(retrievability, 6) AS retrievability FROM f WHERE retrievability < 0.9""")
def journal_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = journal.due_for_review(_twice(spark, sf_dir, True), F.lit(LATER).cast("timestamp"))
    return due.select("repo", "area", F.round("stability", 6).alias("stability"), F.round("retrievability", 6).alias("retrievability"))


@register("journal_history", _BOTH + """,
v AS (
  SELECT repo, area, statement, 0 AS era, EXISTS (SELECT 1 FROM new WHERE new.repo = old.repo AND new.area = old.area AND new.statement = old.statement) AS in_force FROM old
  UNION ALL
  SELECT repo, area, statement, 1, true FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE new.repo = old.repo AND new.area = old.area AND new.statement = old.statement))
SELECT repo, area, statement, row_number() OVER (PARTITION BY repo, area ORDER BY era DESC)::INT AS version, in_force FROM v""")
def journal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.fact_history(_twice(spark, sf_dir, False)).select("repo", "area", "statement", "version", "in_force")


@register("journal_retracted", _BOTH + "SELECT repo, area, total < 62 AS retracted FROM new")
def journal_retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a later measurement, of suppliers with 62 lines or more, no longer gives."""
    facts = return_facts(spark, sf_dir)
    kept = journal.assert_facts(spark.createDataFrame([], journal.JOURNAL), facts, "lines", F.lit(FIRST).cast("timestamp")).drop("outcome")
    fresh = journal.prepared(facts.where("total >= 62"), "lines", F.lit(SECOND).cast("timestamp")).select("repo", "key")
    return journal.retract_missing(kept, fresh, "lines").select("repo", "area", F.col("superseded_by").isNotNull().alias("retracted"))


@register("journal_merge", _BOTH + """
SELECT repo, area, statement, 'lines' AS source FROM old
UNION ALL SELECT repo, area, statement, 'other:lines' FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.repo = new.repo AND old.area = new.area)""")
def journal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal of the early lines, with what another one knows besides."""
    empty, at = spark.createDataFrame([], journal.JOURNAL), F.lit(FIRST).cast("timestamp")
    ours = journal.assert_facts(empty, return_facts(spark, sf_dir, SPLIT), "lines", at).drop("outcome")
    theirs = journal.assert_facts(empty, return_facts(spark, sf_dir), "other:lines", at).drop("outcome")
    return journal.merge_journals(ours, theirs, "other:").select("repo", "area", "statement", "source")


@register("journal_summary", _BOTH + """,
w AS (SELECT *, positive / total AS p, 1.64 * 1.64 AS zz FROM new),
t AS (
  SELECT repo, statement, p, CASE WHEN low >= 0.85 THEN 'law' WHEN low >= 0.6 THEN 'habit' WHEN p >= 0.5 THEN 'hypothesis' END AS tier
  FROM (SELECT *, (p + zz / (2 * total) - 1.64 * sqrt(p * (1 - p) / total + zz / (4 * total * total))) / (1 + zz / total) AS low FROM w))
SELECT repo, coalesce(tier, 'none') AS tier, array_to_string(list(statement ORDER BY -p, statement), '; ') AS lines FROM t GROUP BY ALL""")
def journal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in force, by nation and tier, the firmest first."""
    kept = journal.assert_facts(spark.createDataFrame([], journal.JOURNAL), return_facts(spark, sf_dir), "lines", F.lit(FIRST).cast("timestamp"))
    sections = journal.summary_sections(kept.where("superseded_by IS NULL").withColumn("area", F.lit("returns")))
    return sections.select("repo", F.coalesce("tier", F.lit("none")).alias("tier"), F.array_join("lines", "; ").alias("lines"))


@register("upsert_latest", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    closed = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    return journal.upsert_latest(orders.where(closed), orders.where(~closed), ["o_custkey"], "o_orderkey")
