"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies in the mix.  Among
all rates between 0 and ``max_copies`` that make every source's tokens meet its
target, the ones nearest to 1 in relative entropy have the form

    rate = min(max_copies, exp(lambda * size / mean size of the source))

with one multiplier lambda for each source, the solution of the convex dual.
Newton steps find all multipliers at once: each step is one aggregation of the
gradient and curvature over a histogram of (source, size), kept inside a
bracket so that a step that overshoots turns into a bisection.

Rates become whole copies by systematic rounding along ascending size: the
running sum of the fractional parts decides which documents are rounded up, so
a source misses its target by about one document; a few single-document
corrections then take most of that.

DataFrame operations only.  Sums that decide anything are decimal or whole, so
that the order of partitions changes nothing and reruns agree.  Rows alike in
doc_id, source and text travel as one group with a count, and how many of them
are rounded up is one number; places among the documents of a size are running
totals in two levels.  So no group is one task's work.

Repeated rows are separate documents, each with copies of its own; which of
several rows alike in everything that is kept has the additional copy is not
defined, and makes no difference.  Rows that share a doc_id, or have none, but
differ in text are told apart by the text.  Null text has size 0; a null source
is a source of its own, ordered last.  Documents of size 0 are taken once at no
cost.  Texts of any length are counted whole and do not travel.  An empty table
gives an empty result.  Of the columns only doc_id, source, the text and those
named by ``extra`` are read, whatever the others are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweave.llm.store import materialize, scratch
from signalweave.operators.running import running

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a group that are written out from one row.
SPREAD = 10_000
#: Bisection alone ends well before so many steps; a run that has not is an error.
NEWTON_STEPS = 200
#: Relative miss of a source's tokens at which its multiplier counts as found.
TOLERANCE = 1e-9
CORRECTIONS = 4
#: Rates as whole billionths: their sums are exact.
UNIT = 1_000_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): targets by weight, none above ``most`` times its source.

    Weights repeat over the sources in code-point order, null last.  What a
    source cannot take goes to the others by weight, which is the same as one
    level x with target = min(most * size, x * weight): sources reach their cap
    in the order of cap / weight, so running sums in that order give x.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    caps = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    running = (
        caps.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("goal", F.sum("source_size").over(everything) * F.lit(share))
    )
    level = (F.col("goal") - F.col("capped")) / F.col("open_weight")
    # The level is the first at which the next source to be capped is not.
    found = running.withColumn("level", level).withColumn("ok", F.col("level") <= F.col("cap") / F.col("weight"))
    x = F.min(F.when(F.col("ok"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return found.withColumn("x", x).select("source", "source_size", F.when(F.col("x").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("x") * F.col("weight"))).alias("target"))


def _exact(value: Column) -> Column:
    """A value whose sum does not depend on the order of rows."""
    return value.cast("decimal(38,9)")


def _rate(most: float) -> Column:
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("x"))))


def multipliers(histogram: DataFrame, targets: DataFrame, most: float = 2.0) -> DataFrame:
    """(source, mean, multiplier, full) by Newton steps on the dual, one job a step.

    ``histogram`` is (source, size, n).  ``full``: the target takes all that
    ``most`` copies give, so every document has that rate.
    """
    sized = histogram.where(F.col("size") > 0)
    means = sized.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), (F.min("size")).alias("least"), F.max("size").alias("largest"))
    state = targets.join(means, targets["source"].eqNullSafe(means["source"])).drop(means["source"])
    state = state.withColumn("full", F.col("target") >= F.col("source_size") * F.lit(most) * (1 - 1e-12))
    # Below the bracket the rates vanish, at its top every rate is at the most.
    state = state.select("source", "target", "mean", "full", F.lit(0.0).alias("multiplier"), (-80.0 * F.col("mean") / F.col("least")).alias("lo"), (F.log(F.lit(float(most))) * F.col("mean") / F.col("least")).alias("hi"), F.col("full").alias("found"))
    state = materialize(state, "multipliers")
    for _ in range(NEWTON_STEPS):
        open_state = state.where(~F.col("found")).select(F.col("source").alias("s"), "mean", "multiplier", "full")
        x = sized.join(open_state, sized["source"].eqNullSafe(open_state["s"])).withColumn("x", F.col("size") / F.col("mean"))
        rate = _rate(most)
        tokens = F.col("size") * F.col("n") * rate
        bend = F.when(rate < most, tokens * F.col("x")).otherwise(0.0)
        sums = x.groupBy("s").agg(F.sum(_exact(tokens)).cast("double").alias("tokens"), F.sum(_exact(bend)).cast("double").alias("bend"))
        joined = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        miss = F.col("tokens") - F.col("target")
        lo, hi = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("lo")), F.when(miss < 0, F.col("hi")).otherwise(F.col("multiplier"))
        newton = F.col("multiplier") - F.try_divide(miss, F.col("bend"))
        step = F.when(newton.isNotNull() & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        done = F.col("found") | (F.abs(miss) <= F.col("target") * F.lit(TOLERANCE) + F.lit(1e-6)) | (hi - lo < 1e-13)
        keep = F.col("found") | F.col("tokens").isNull()
        state = materialize(
            joined.select("source", "target", "mean", "full", F.when(keep | done, F.col("multiplier")).otherwise(step).alias("multiplier"), F.when(keep, F.col("lo")).otherwise(lo).alias("lo"), F.when(keep, F.col("hi")).otherwise(hi).alias("hi"), (keep | done).alias("found")),
            "multipliers",
        )
        if state.where(~F.col("found")).isEmpty():
            return state.select("source", "mean", "multiplier", "full")
    raise RuntimeError("the multipliers were not found")


def _whole(value: Column) -> Column:
    """The whole part of a number of billionths."""
    return F.call_function("div", value, F.lit(UNIT).cast("decimal(10,0)"))


def mix_groups(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each group of rows alike in doc_id, source, text hash and the ``extra`` columns.

    doc_id, source, row (the hash), size, x0, x1, ... (the extra columns), n (its
    rows), rate (in billionths), base (copies of each row) and ups (rows of it that
    have one copy more), source_size, target.
    """
    with scratch() as keep:
        plain = docs.select("doc_id", "source", F.xxhash64(F.col(text)).alias("row"), word_count(F.col(text)).alias("size"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)])
        # A document's place among those of its source and size is by hash.
        lot = F.xxhash64("doc_id", "row", "source", F.lit(8))
        groups = materialize(plain.groupBy(*plain.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("lot", lot), "mixing")
        histogram = materialize(groups.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
        sizes = histogram.select("source", (F.col("size") * F.col("n")).alias("size"))
        targets = keep(materialize(source_targets(sizes, weights, share, float(most)), "targets"))
        tilt = multipliers(histogram, targets, float(most))

        found = histogram.join(tilt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("x", F.col("size") / F.col("mean"))
        rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(float(most)))
        found = found.select("source", "size", "n", F.round(rate * UNIT).cast("bigint").alias("rate"))
        part_rate = F.pmod("rate", F.lit(UNIT)).cast("decimal(10,0)")
        # Sizes of a source in ascending order: what the smaller ones take.
        ascending = running(found, ["source"], ["size"], {"upto": part_rate * F.col("n").cast("decimal(19,0)")}, lambda df: materialize(df, "rates"))
        rates = ascending.select(F.col("source").alias("r_source"), F.col("size").alias("r_size"), "rate", part_rate.alias("part_rate"), (F.col("upto") - part_rate * F.col("n").cast("decimal(19,0)")).alias("before"))

        placed = running(groups, ["source", "size"], ["lot", "doc_id", "row", *[f"x{i}" for i in range(len(extra))]], {"place": F.col("n")}, lambda df: materialize(df, "places"))
        joined = placed.join(rates, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size"))).drop("r_source", "r_size")
        # Half a unit of offset rounds to the nearest count.
        upto = F.col("before") + F.col("part_rate") * F.col("place").cast("decimal(19,0)") + F.lit(UNIT // 2)
        ups = _whole(upto) - _whole(upto - F.col("part_rate") * F.col("n").cast("decimal(19,0)"))
        out = joined.select(*groups.columns, "rate", F.floor(F.col("rate") / UNIT).alias("base"), ups.alias("ups"), (F.col("part_rate") > 0).alias("loose"))
        out = keep(materialize(out, "copies"))

        t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
        flips = None
        for _ in range(CORRECTIONS):
            now = out if flips is None else _flipped(out, flips)
            taken = now.groupBy("source").agg(F.sum(F.col("size") * (F.col("base") * F.col("n") + F.col("ups"))).alias("taken"))
            gap = taken.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("t_source").alias("g_source"), (F.col("target") - F.col("taken")).alias("gap"))
            loose = now.where(F.col("loose")).join(gap, F.col("source").eqNullSafe(F.col("g_source")))
            turn = F.when((F.col("gap") > 0) & (F.col("ups") < F.col("n")), 1).when((F.col("gap") < 0) & (F.col("ups") > 0), -1)
            miss = F.abs(F.col("gap") - turn * F.col("size"))
            helpful = loose.withColumn("turn", turn).withColumn("miss", miss).where((F.col("miss") < F.abs(F.col("gap"))))
            name = ["doc_id", "row", *[f"x{i}" for i in range(len(extra))]]
            best = helpful.groupBy("g_source").agg(F.min(F.struct("miss", "lot", *name, "size", "turn")).alias("b"))
            step = best.select(F.col("g_source").alias("f_source"), *[F.col(f"b.{c}").alias(f"f_{c}") for c in [*name, "size"]], F.col("b.turn").cast("bigint").alias("turn"))
            flips = materialize(step if flips is None else flips.unionByName(step), "flips")
        keep(flips)
    out = _flipped(out, flips)
    return out.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source", "lot", "loose")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken, and the ``extra`` columns: a row for each of the documents."""
    names = ["doc_id", "source", "size", *extra, "source_size", "target", "rate", "copies", "taken"]
    if len(set(names)) < len(names):
        raise ValueError("an extra column has the name of one of the result")
    groups = mix_groups(docs, weights, share, most, text, extra)
    # The rows of a group in two steps, so that no array grows with the group.
    spans = groups.withColumn("span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / SPREAD))))
    first, last = F.col("span") * SPREAD + 1, F.least((F.col("span") + 1) * SPREAD, F.col("n"))
    rows = spans.withColumn("i", F.explode(F.sequence(first, last)))
    copies = F.col("base") + (F.col("i") <= F.col("ups")).cast("bigint")
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", *[F.col(f"x{i}").alias(c) for i, c in enumerate(extra)], "source_size", "target", (F.col("rate") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _flipped(groups: DataFrame, flips: DataFrame) -> DataFrame:
    """Applies single-document corrections; there are at most CORRECTIONS of them for a source."""
    keys = [c for c in flips.columns if c != "turn"]
    net = flips.groupBy(*keys).agg(F.sum("turn").alias("turn"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k[2:]).eqNullSafe(F.col(k))
    joined = groups.join(net, same, "left")
    return joined.withColumn("ups", F.col("ups") + F.coalesce("turn", F.lit(0))).drop(*keys, "turn")
