"""What an activity log tells: heat, use, sessions, streaks, trends.

Batch forms only; none of them is built over streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweave.functions.expressions import days_between
from signalweave.operators.running import running


def decayed_heat(touches: DataFrame, now: Column, half_life_days: float = 3.0) -> DataFrame:
    """(key, heat, touches, last_ts): every touch adds 1, and halves each half-life; order does not matter."""
    age = F.greatest(days_between(now, F.col("ts")), F.lit(0.0))
    weight = F.pow(F.lit(0.5), age / half_life_days)
    return touches.groupBy("key").agg(F.sum(weight).alias("heat"), F.count(F.lit(1)).alias("touches"), F.max("ts").alias("last_ts"))


def first_claims(feed: DataFrame) -> DataFrame:
    """The first row of each (session_id, key)."""
    first = Window.partitionBy("session_id", "key").orderBy("ts", "event_id")
    return feed.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r")


def attribute_use(surfaced: DataFrame, touches: DataFrame) -> DataFrame:
    """(session_id, key, ts, used_at): the first touch of the key in the session at or after it was surfaced.

    One union and one window instead of a join on a time range: looking ahead
    from each surfaced row is linear in a session's events.
    """
    both = surfaced.select("session_id", "key", "ts", F.lit(0).alias("_touch")).unionByName(touches.select("session_id", "key", "ts", F.lit(1).alias("_touch")))
    ahead = Window.partitionBy("session_id", "key").orderBy("ts", "_touch").rowsBetween(1, Window.unboundedFollowing)
    used = F.min(F.when(F.col("_touch") == 1, F.col("ts"))).over(ahead)
    return both.withColumn("used_at", used).where(F.col("_touch") == 0).drop("_touch")


def feed_utility(used: DataFrame, min_surfaced: int = 12, mute_below: float = 0.15) -> DataFrame:
    """(kind, surfaced, used, score, rank, muted) with Laplace smoothing; ``used``: kind, was_used."""
    sums = used.groupBy("kind").agg(F.count(F.lit(1)).alias("surfaced"), F.count_if("was_used").alias("used"))
    scored = sums.withColumn("score", (F.col("used") + 1) / (F.col("surfaced") + 2))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "kind"))
    return scored.withColumn("rank", rank).withColumn("muted", (F.col("surfaced") >= min_surfaced) & (F.col("score") < mute_below))


def explore_gate(attempts: DataFrame, every: int = 10) -> DataFrame:
    """Marks which attempts of a muted kind pass: every so many; a kind's attempts are numbered in two levels."""
    numbered = running(attempts, ["kind"], ["ts", "event_id"], {"attempt": F.lit(1)})
    return numbered.withColumn("passes", F.col("attempt") % every == 0)


def sessions_by_gap(events: DataFrame, idle_minutes: float = 30.0) -> DataFrame:
    """(user_id, session, start, end, events): a session ends where the next event is too far."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = days_between(F.col("ts"), F.lag("ts").over(order)) * 1440
    marked = events.select("user_id", "ts", "event_id", F.coalesce((gap > idle_minutes).cast("int"), F.lit(1)).alias("_new"))
    numbered = marked.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"))


def session_lifecycle(events: DataFrame, now: Column, max_age_hours: float = 12.0, idle_hours: float = 6.0) -> DataFrame:
    """(session_id, opened_at, closed_at, last_at, state): the first close wins; old or idle ones count as lapsed.

    ``events``: session_id, event (open, activity, close), ts.
    """
    at = lambda kind: F.min(F.when(F.col("event") == kind, F.col("ts")))
    folded = events.groupBy("session_id").agg(at("open").alias("opened_at"), at("close").alias("closed_at"), F.max("ts").alias("last_at"))
    age, idle = days_between(now, F.col("opened_at")) * 24, days_between(now, F.col("last_at")) * 24
    state = F.when(F.col("closed_at").isNotNull(), "closed").when(age > max_age_hours, "too old").when(idle > idle_hours, "idle").otherwise("open")
    return folded.withColumn("state", state)


def visit_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("key").agg(F.count(F.lit(1)).alias("visits"), F.max("ts").alias("last_at"))


def violation_streaks(turns: DataFrame, limit: int = 8) -> DataFrame:
    """(session_id, turn, streak, released): dirty turns in a row; from ``limit`` on the session is let go.

    ``turns``: session_id, turn, dirty.
    """
    order = Window.partitionBy("session_id").orderBy("turn")
    islands = turns.withColumn("_clean", F.sum(F.when(F.col("dirty"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.when(F.col("dirty"), 1).otherwise(0)).over(Window.partitionBy("session_id", "_clean").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    counted = islands.withColumn("streak", streak).drop("_clean")
    return counted.withColumn("released", F.max("streak").over(order.rowsBetween(Window.unboundedPreceding, 0)) >= limit)


def channel_pulse(beats: DataFrame) -> DataFrame:
    """The latest beat of each channel."""
    return beats.groupBy("channel").agg(F.max("ts").alias("last_ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def silent_channels(channels: DataFrame, beats: DataFrame, sessions: DataFrame, n: int = 3) -> DataFrame:
    """(channel, last_ts, silent): no beat since the n-th latest session began, or none at all."""
    since = sessions.select("start").orderBy(F.desc("start")).limit(n).agg(F.min("start").alias("_since"), F.count(F.lit(1)).alias("_n"))
    last = beats.groupBy("channel").agg(F.max("ts").alias("last_ts"))
    joined = channels.join(last, "channel", "left").crossJoin(F.broadcast(since))
    return joined.select("channel", "last_ts", ((F.col("_n") == n) & (F.col("last_ts").isNull() | (F.col("last_ts") < F.col("_since")))).alias("silent"))


def keep_recent(rows: DataFrame, sessions: DataFrame, n: int = 30) -> DataFrame:
    """Rows of the n latest sessions; all of them where there are fewer."""
    latest = sessions.select("session_id", "start").orderBy(F.desc("start"), "session_id").limit(n)
    return rows.join(latest.select("session_id"), "session_id", "left_semi")


def recent_outcomes(runs: DataFrame, now: Column, hours: float = 72.0) -> DataFrame:
    """(job, outcome, ts, failed): the last outcome of each job within some hours."""
    near = runs.where(days_between(now, F.col("ts")) * 24 <= hours)
    return near.groupBy("job").agg(F.max_by("outcome", F.struct("ts", "run_id")).alias("outcome"), F.max("ts").alias("ts")).withColumn("failed", F.col("outcome") == "error")


def drift(snapshots: DataFrame, metrics: list[str], window: int = 8) -> DataFrame:
    """(repo, metric, latest, base, delta, span): the newest snapshot against one up to ``window`` before it.

    Of a repo only its newest ``window`` + 1 snapshots leave a task, so a repo of
    any length costs a few rows.
    """
    order = Window.partitionBy("repo").orderBy(F.desc("ts"))
    newest = snapshots.select("repo", "ts", *metrics).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= window + 1)
    ranked = newest.withColumn("_n", F.max("_r").over(Window.partitionBy("repo")))
    two = ranked.where((F.col("_n") >= 2) & ((F.col("_r") == 1) | (F.col("_r") == F.col("_n")))).withColumn("_back", F.col("_n") - 1)
    long = two.select("repo", "_r", "_back", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    pick = lambda c: F.max(F.when(c, F.col("value")))
    out = long.groupBy("repo", "metric").agg(pick(F.col("_r") == 1).alias("latest"), pick(F.col("_r") > 1).alias("base"), F.max("_back").cast("bigint").alias("span"))
    return out.select("repo", "metric", "latest", "base", (F.col("latest") - F.col("base")).alias("delta"), "span")


def drift_alarms(changes: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Changes for the worse: a positive threshold warns of a rise, a negative one of a fall."""
    rules = [(F.col("metric") == m) & ((F.col("delta") >= t) if t > 0 else (F.col("delta") <= t)) for m, t in thresholds.items()]
    hit = rules[0]
    for r in rules[1:]:
        hit = hit | r
    return changes.where(hit)


def rank_tiers(nodes: DataFrame) -> DataFrame:
    """Adds place and level by position from the top: 5, 20 and 50 percent, and the rest; a repo's nodes are numbered in two levels."""
    numbered = running(nodes, ["repo"], [F.desc("rank"), "node"], {"place": F.lit(1)}).withColumn("place", F.col("place") - 1)
    sizes = nodes.groupBy(F.col("repo").alias("_repo")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("place") / F.col("_n")
    level = F.when(share <= 0.05, "core").when(share <= 0.2, "major").when(share <= 0.5, "common").otherwise("edge")
    return numbered.join(sizes, F.col("repo").eqNullSafe(F.col("_repo"))).withColumn("level", level).drop("_repo", "_n")


def segment_map(nodes: DataFrame, k: int = 10, members: int = 3) -> DataFrame:
    """(repo, segment, total_rank, nodes, top): the k segments of largest total rank with their first members."""
    best = Window.partitionBy("repo", "segment").orderBy(F.desc("rank"), "node")
    first = nodes.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= members)
    named = first.groupBy("repo", "segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "node"))), lambda x: x["node"]).alias("top"))
    sums = nodes.groupBy("repo", "segment").agg(F.sum("rank").alias("total_rank"), F.count(F.lit(1)).alias("nodes"))
    top = Window.partitionBy("repo").orderBy(F.desc("total_rank"), "segment")
    return sums.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k).drop("_r").join(named, ["repo", "segment"])


def sample_systematic(docs: DataFrame, key: str, n: int = 60) -> DataFrame:
    """About n rows at even distances in key order, the first one included; rows are numbered in two levels."""
    numbered = running(docs, [], [key], {"_r": F.lit(1)})
    total = numbered.count()
    return numbered.where((F.col("_r") - 1) % max(1, total // n) == 0).drop("_r")
