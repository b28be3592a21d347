"""Activity queries over ``events``: a user is a session or a reader, an event type a channel or kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.operators import telemetry as T
from signalweave.registry import register, table

NOW = "2030-01-01 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant for ts, whatever kind of timestamp the files hold."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def last_instant(rows: DataFrame) -> F.Column:
    return F.lit(rows.agg(F.max("ts")).first()[0]).cast("timestamp")


_END = "(SELECT max(ts) FROM events)"


@register("decayed_heat", f"""
SELECT user_id AS key, round(sum(pow(0.5, epoch_us({_END}) / 86400000000.0 / 3 - epoch_us(ts) / 86400000000.0 / 3)), 6) AS heat, count(*) AS touches
FROM events GROUP BY user_id""")
def decayed_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    heat = T.decayed_heat(e.select(F.col("user_id").alias("key"), "ts"), last_instant(e))
    return heat.select("key", F.round("heat", 6).alias("heat"), "touches")


@register("first_claims", """
SELECT user_id AS session_id, event_type AS key, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def first_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return T.first_claims(e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), "ts", "event_id")).select("session_id", "key", "event_id")


_USED = """
WITH s AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
t AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
u AS (SELECT s.user_id, s.ts, min(t.ts) AS used_at FROM s LEFT JOIN t ON s.user_id = t.user_id AND t.ts >= s.ts GROUP BY ALL)
"""


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.lit("item").alias("key"), "ts", "event_type")
    return T.attribute_use(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"))


@register("attribute_use", _USED + "SELECT user_id AS session_id, count(*) AS surfaced, count(used_at) AS used, round(coalesce(sum(epoch_us(used_at) - epoch_us(ts)), 0) / 1000000.0, 3) AS wait_s FROM (SELECT s.user_id, s.ts, (SELECT used_at FROM u WHERE u.user_id = s.user_id AND u.ts = s.ts) AS used_at FROM s) GROUP BY ALL")
def attribute_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    wait = F.sum(F.unix_micros("used_at") - F.unix_micros("ts"))
    return _used(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("surfaced"), F.count("used_at").alias("used"), F.round(F.coalesce(wait, F.lit(0)) / 1_000_000, 3).alias("wait_s"))


@register("feed_utility", """
WITH k AS (SELECT event_type AS kind, count(*) AS surfaced, count(*) FILTER (value > 50) AS used FROM events GROUP BY ALL),
s AS (SELECT *, (used + 1) / (surfaced + 2) AS score FROM k)
SELECT kind, surfaced, used, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, kind)::INT AS rank, surfaced >= 12 AND score < 0.15 AS muted FROM s""")
def feed_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("event_type").alias("kind"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("was_used"))
    return T.feed_utility(e).withColumn("score", F.round("score", 9))


@register("explore_gate", """
SELECT kind, count(*) AS attempts, count(*) FILTER (n % 10 = 0) AS passed FROM (
  SELECT event_type AS kind, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE value < 20) GROUP BY kind""")
def explore_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("value < 20").withColumnRenamed("event_type", "kind")
    return T.explore_gate(e).groupBy("kind").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("passes").alias("passed"))


_SESSIONS = """
WITH g AS (
  SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
"""


@register("sessions_by_gap", _SESSIONS + "SELECT user_id, session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events FROM n GROUP BY ALL")
def sessions_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sessions_by_gap(events(spark, sf_dir))
    return s.select("user_id", "session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@register("session_lifecycle", f"""
WITH f AS (
  SELECT user_id AS session_id, min(ts) FILTER (event_type = 'view') AS opened_at, min(ts) FILTER (event_type = 'purchase' AND value > 90) AS closed_at, max(ts) AS last_at
  FROM events GROUP BY user_id)
SELECT session_id, epoch_us(last_at) AS last_us,
  CASE WHEN closed_at IS NOT NULL THEN 'closed' WHEN (epoch_us({_END}) - epoch_us(opened_at)) / 3600000000.0 > 12 THEN 'too old'
       WHEN (epoch_us({_END}) - epoch_us(last_at)) / 3600000000.0 > 6 THEN 'idle' ELSE 'open' END AS state
FROM f""")
def session_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "open").when((F.col("event_type") == "purchase") & (F.col("value") > 90), "close").otherwise("activity")
    life = T.session_lifecycle(e.select(F.col("user_id").alias("session_id"), kind.alias("event"), "ts"), last_instant(e))
    return life.select("session_id", F.unix_micros("last_at").alias("last_us"), "state")


@register("visit_counts", "SELECT user_id AS key, count(*) AS visits, epoch_us(max(ts)) AS last_us FROM events GROUP BY ALL")
def visit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.visit_counts(events(spark, sf_dir).withColumnRenamed("user_id", "key"))
    return v.select("key", "visits", F.unix_micros("last_at").alias("last_us"))


@register("violation_streaks", """
WITH t AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type = 'error' AS dirty FROM events),
c AS (SELECT *, sum(CASE WHEN dirty THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM t),
s AS (SELECT *, sum(CASE WHEN dirty THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM c)
SELECT session_id, max(streak) AS longest, count(*) FILTER (streak = 1) AS streaks, count(*) FILTER (r) AS released FROM (
  SELECT *, max(streak) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING) >= 3 AS r FROM s) GROUP BY session_id""")
def violation_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    turns = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), turn.alias("turn"), (F.col("event_type") == "error").alias("dirty"))
    s = T.violation_streaks(turns, limit=3)
    return s.groupBy("session_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") == 1).alias("streaks"), F.count_if("released").alias("released"))


@register("channel_pulse", "SELECT event_type AS channel, epoch_us(max(ts)) AS last_us, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def channel_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.channel_pulse(events(spark, sf_dir).withColumnRenamed("event_type", "channel"))
    return p.select("channel", F.unix_micros("last_ts").alias("last_us"), "value")


_STARTS = _SESSIONS + ", st AS (SELECT user_id, session, min(ts) AS start FROM n GROUP BY ALL)"


@register("silent_channels", _STARTS + """
, since AS (SELECT min(start) AS s FROM (SELECT start FROM st ORDER BY start DESC LIMIT 3))
SELECT user_id AS channel, max(ts) < (SELECT s FROM since) AS silent FROM events GROUP BY user_id""")
def silent_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    beats = e.select(F.col("user_id").alias("channel"), "ts")
    return T.silent_channels(beats.select("channel").distinct(), beats, T.sessions_by_gap(e), 3).select("channel", "silent")


@register("recent_outcomes", f"""
SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS outcome, arg_max(event_type, (ts, event_id)) = 'error' AS failed
FROM events WHERE (epoch_us({_END}) - epoch_us(ts)) / 3600000000.0 <= 72 GROUP BY user_id""")
def recent_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    runs = e.select(F.col("user_id").alias("job"), F.col("event_type").alias("outcome"), "ts", F.col("event_id").alias("run_id"))
    return T.recent_outcomes(runs, last_instant(e)).select("job", "outcome", "failed")


_DAYS = """
WITH d AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, avg(value) AS mean FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS r, count(*) OVER () AS c FROM d),
p AS (SELECT a.n AS n1, b.n AS n0, a.errors AS e1, b.errors AS e0, a.mean AS m1, b.mean AS m0, least(8, a.c - 1) AS span FROM r a JOIN r b ON a.r = 1 AND b.r = least(8, a.c - 1) + 1 WHERE a.c >= 2),
l AS (SELECT 'n' AS metric, n1::DOUBLE AS latest, n0::DOUBLE AS base, span FROM p UNION ALL SELECT 'errors', e1, e0, span FROM p UNION ALL SELECT 'mean', m1, m0, span FROM p)
"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    daily = e.groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean"))
    return T.drift(daily.withColumn("repo", F.lit("events")), ["n", "errors", "mean"])


@register("drift", _DAYS + "SELECT metric, round(latest, 6) AS latest, round(base, 6) AS base, round(latest - base, 6) AS delta, span::BIGINT AS span FROM l")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("metric", *[F.round(c, 6).alias(c) for c in ("latest", "base", "delta")], "span")


@register("drift_alarms", _DAYS + "SELECT metric, round(latest - base, 6) AS delta FROM l WHERE (metric = 'n' AND latest - base <= -1) OR (metric = 'errors' AND latest - base >= 1) OR (metric = 'mean' AND latest - base <= -0.03)")
def drift_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    alarms = T.drift_alarms(_drift(spark, sf_dir), {"n": -1.0, "errors": 1.0, "mean": -0.03})
    return alarms.select("metric", F.round("delta", 6).alias("delta"))


@register("event_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events) WHERE r % greatest(1, n // 60) = 0")
def event_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About sixty events at even distances."""
    return T.sample_systematic(events(spark, sf_dir).select("event_id"), "event_id", 60)


@register("recent_events", _STARTS + """,
k AS (SELECT user_id, session FROM st ORDER BY start DESC, user_id || '/' || session LIMIT 30)
SELECT n.event_id FROM n JOIN k USING (user_id, session)""")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the thirty latest sessions hold."""
    e = events(spark, sf_dir)
    spans = T.sessions_by_gap(e).withColumn("session_id", F.concat_ws("/", "user_id", "session"))
    inside = e.alias("e").join(spans.alias("s"), (F.col("e.user_id") == F.col("s.user_id")) & F.col("e.ts").between(F.col("s.start"), F.col("s.end"))).select("event_id", "session_id")
    return T.keep_recent(inside, spans.select("session_id", "start"), 30).select("event_id")
