"""An append-only journal of facts: superseded rather than overwritten, aging until confirmed.

A journal row is in force while ``superseded_by`` is null; 0 marks a retraction.
Rows are keyed by repo and key; at most one row of a key is in force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweave.functions import expressions as X
from signalweave.operators.running import running

JOURNAL = (
    "repo string, id bigint, key string, area string, statement string, tier string, prevalence double, positive bigint, total bigint, source string, "
    "asserted_at timestamp, seen_at timestamp, superseded_by bigint, rating double, deviation double, confirmations bigint, stability double"
)
COLUMNS = [c.strip().split()[0] for c in JOURNAL.split(",")]


def prepared(incoming: DataFrame, source: str, now: Column, modelled: bool = False, stability_days: float = 14.0) -> DataFrame:
    """Incoming facts (repo, area, statement, prevalence, positive, total) as journal rows without ids; the last row of a key counts."""
    m = F.lit(modelled)
    rows = incoming.withColumn("key", X.fact_key(F.col("area"), F.col("statement")))
    last = Window.partitionBy("repo", "key").orderBy(F.desc("total"), "statement")
    rows = rows.withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1)
    return rows.select(
        "repo", "key", "area", "statement", X.tier(F.col("prevalence"), F.col("total")).alias("tier"), "prevalence", "positive", "total", F.lit(source).alias("source"),
        now.alias("asserted_at"), now.alias("seen_at"), F.lit(None).cast("bigint").alias("superseded_by"),
        X.init_rating(F.col("prevalence"), F.col("total"), m).alias("rating"), X.init_deviation(F.col("prevalence"), F.col("total"), m).alias("deviation"), F.lit(1).cast("bigint").alias("confirmations"),
        F.when(m, F.lit(float(stability_days))).alias("stability"),
    )


def assert_facts(journal: DataFrame, incoming: DataFrame, source: str, now: Column, modelled: bool = False) -> DataFrame:
    """The journal after a batch, with an ``outcome`` for each row: kept, confirmed, born, changed or superseded.

    A key in force with the same statement is confirmed in place; with another
    statement it is superseded by a new row; a new key is born.  One full join
    of the rows in force with the batch decides all three.
    """
    new = prepared(incoming, source, now, modelled)
    active, past = journal.where(F.col("superseded_by").isNull()), journal.where(F.col("superseded_by").isNotNull())
    a, b = active.alias("a"), new.alias("b")
    both = a.join(b, (F.col("a.repo") == F.col("b.repo")) & (F.col("a.key") == F.col("b.key")), "full")
    top = journal.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    outcome = (
        F.when(F.col("b.key").isNull(), F.lit("kept")).when(F.col("a.key").isNull(), F.lit("born")).when(F.col("a.statement") == F.col("b.statement"), F.lit("confirmed")).otherwise(F.lit("changed"))
    )
    both = both.withColumn("outcome", outcome)
    # New ids continue the journal's, in the order of repo and key.
    fresh = both.where(F.col("outcome").isin("born", "changed"))
    keys = running(fresh.select(F.col("b.repo").alias("_repo"), F.col("b.key").alias("_key")), [], ["_repo", "_key"], {"_place": F.lit(1)})
    named = fresh.join(keys, F.col("b.repo").eqNullSafe(F.col("_repo")) & F.col("b.key").eqNullSafe(F.col("_key")))
    fresh = named.crossJoin(F.broadcast(top)).withColumn("_id", F.col("_top") + F.col("_place"))
    born = fresh.select(*[(F.col("_id") if c == "id" else F.col(f"b.{c}")).alias(c) for c in COLUMNS], F.when(F.col("outcome") == "born", "born").otherwise("changed").alias("outcome"))
    replaced = fresh.where(F.col("outcome") == "changed").select(*[(F.col("_id") if c == "superseded_by" else F.col(f"a.{c}")).alias(c) for c in COLUMNS], F.lit("superseded").alias("outcome"))
    kept = both.where(F.col("outcome") == "kept").select(*[F.col(f"a.{c}").alias(c) for c in COLUMNS], "outcome")
    again = {
        "prevalence": F.col("b.prevalence"), "positive": F.col("b.positive"), "total": F.col("b.total"), "seen_at": F.col("b.seen_at"),
        "rating": X.confirm_rating(F.col("a.rating"), F.col("a.deviation"), F.col("b.rating"), F.col("b.deviation")), "deviation": X.confirm_deviation(F.col("a.deviation"), F.col("b.deviation")), "confirmations": F.col("a.confirmations") + 1,
        "stability": X.confirm_stability(F.col("a.stability"), X.retrievability(F.col("a.stability"), X.days_between(now, F.col("a.seen_at")))),
    }
    confirmed = both.where(F.col("outcome") == "confirmed").select(*[again.get(c, F.col(f"a.{c}")).alias(c) for c in COLUMNS], "outcome")
    return past.select(*COLUMNS, F.lit("kept").alias("outcome")).unionByName(kept).unionByName(confirmed).unionByName(replaced).unionByName(born)


def missing_keys(journal: DataFrame, fresh_keys: DataFrame, source: str) -> DataFrame:
    """Rows in force of one source whose key a fresh measurement no longer gives."""
    return journal.where(F.col("superseded_by").isNull() & (F.col("source") == source)).join(fresh_keys.select("repo", "key").distinct(), ["repo", "key"], "left_anti").select(journal.columns)


def retract_missing(journal: DataFrame, fresh_keys: DataFrame, source: str) -> DataFrame:
    """The journal with those rows marked as retracted."""
    keys = fresh_keys.select("repo", "key").distinct().withColumn("_fresh", F.lit(True))
    gone = F.col("superseded_by").isNull() & (F.col("source") == source) & F.col("_fresh").isNull()
    return journal.join(keys, ["repo", "key"], "left").withColumn("superseded_by", F.when(gone, F.lit(0)).otherwise(F.col("superseded_by")).cast("bigint")).select(journal.columns)


def touch_all(journal: DataFrame, now: Column) -> DataFrame:
    """Measured facts in force count as seen now, as when their inputs are unchanged."""
    measured = F.col("superseded_by").isNull() & F.col("stability").isNull()
    return journal.withColumn("seen_at", F.when(measured, now).otherwise(F.col("seen_at")))


def active_facts(journal: DataFrame, now: Column) -> DataFrame:
    """Rows in force with the tier they have now."""
    idle = X.days_between(now, F.col("seen_at"))
    aged = journal.where(F.col("superseded_by").isNull()).withColumn("effective_deviation", X.effective_deviation(F.col("deviation"), idle))
    return aged.withColumn("live_tier", X.live_tier(F.col("rating"), F.col("effective_deviation")))


def due_for_review(journal: DataFrame, now: Column, below: float = 0.9) -> DataFrame:
    """Facts of a model, in force, that are likely forgotten."""
    r = X.retrievability(F.col("stability"), X.days_between(now, F.col("seen_at")))
    return journal.where(F.col("superseded_by").isNull() & F.col("stability").isNotNull()).withColumn("retrievability", r).where(F.col("retrievability") < below)


def fact_history(journal: DataFrame) -> DataFrame:
    """Every version of a key, the newest first, with whether it is in force and when the next one came."""
    order = Window.partitionBy("repo", "key").orderBy(F.desc("asserted_at"), F.desc("id"))
    return journal.withColumns({"version": F.row_number().over(order), "in_force": F.col("superseded_by").isNull(), "replaced_at": F.lag("asserted_at").over(order)})


def merge_journals(dst: DataFrame, src: DataFrame, source_prefix: str) -> DataFrame:
    """Adds to ``dst`` the rows in force of one kind of source whose key is not in force there."""
    have = dst.where(F.col("superseded_by").isNull()).select("repo", "key").distinct()
    new = src.where(F.col("superseded_by").isNull() & F.col("source").startswith(source_prefix)).join(have, ["repo", "key"], "left_anti")
    return dst.unionByName(new.select(dst.columns))


def summary_sections(facts: DataFrame) -> DataFrame:
    """(repo, tier, area, lines): statements in force by tier and area, the firmest first."""
    line = F.struct((-F.col("prevalence")).alias("p"), F.col("statement").alias("s"))
    return facts.groupBy("repo", "tier", "area").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["s"]).alias("lines"))


def upsert_latest(base: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union in which the latest row of each key stays.

    Of rows of a key with one ``order`` those of ``delta`` come first, and among
    these the one with the greatest values, column by column, so that reruns agree.
    """
    both = base.withColumn("_late", F.lit(0)).unionByName(delta.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    rest = [F.desc_nulls_last(c) for c in sorted(both.columns) if c not in (*keys, order, "_late") and both.schema[c].dataType.typeName() not in ("map", "variant")]
    latest = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_late"), *rest)
    return both.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") == 1).drop("_r", "_late")
