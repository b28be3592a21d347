"""Running totals in two levels, for groups of any size.

A window over a key is one task's work, however large the group.  Here rows are
dealt into ranges of (keys, order) first, totals run inside each range, and what
earlier ranges of the same key hold is added: a key with a third of all rows
takes a third of the tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweave.storage import cut


def running(rows: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, Column], store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``rows`` with a column for each of ``totals``: its sum over the rows of the same keys up to this one.

    ``order`` should tell rows of a key apart; rows that it does not come in some
    order.  Keys may be null; without keys all rows are one group.  A total of
    nulls alone is null, other nulls count as 0.  ``store`` writes the rows once
    and reads them again.
    """
    by = [F.col(k) for k in keys]
    ordered = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = rows.repartitionByRange(*by, *ordered).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy(*by, "_range").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    local = store(dealt.withColumns({f"_run_{name}": F.sum(value).over(inside) for name, value in totals.items()} | {f"_own_{name}": value for name, value in totals.items()}))
    sums = local.groupBy(*by, "_range").agg(*[F.sum(f"_own_{name}").alias(f"_sum_{name}") for name in totals])
    # Only the first and the last key of a range lie in others too, so these are at most two rows a range.
    several = Window.partitionBy(*by)
    before = several.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spread = sums.groupBy(*by).agg(F.min("_range").alias("_lo"), F.max("_range").alias("_hi")).where(F.col("_lo") < F.col("_hi")).drop("_lo", "_hi")
    spread = spread.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    of_spread = sums.join(F.broadcast(spread), same).drop(*[f"_s_{k}" for k in keys])
    earlier = of_spread.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_range").alias("_b_range"), *[F.sum(f"_sum_{name}").over(before).alias(f"_before_{name}") for name in totals])
    here = F.col("_range") == F.col("_b_range")
    for k in keys:
        here = here & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    joined = local.join(F.broadcast(earlier), here, "left")
    found = []
    for name in totals:
        run, prior = F.col(f"_run_{name}"), F.col(f"_before_{name}")
        found.append(F.when(run.isNull(), prior).when(prior.isNull(), run).otherwise(run + prior).alias(name))
    return joined.select(*rows.columns, *found)
