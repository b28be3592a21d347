from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from signalweave.operators.running import running


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_totals(spark, parts):
    rng = random.Random(3)
    # One key has most rows, one is null, some values are missing.
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.choice([1, 2, -3, None])) for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "k string, i int, x int")
        got = {r.i: (r.n, r.total) for r in running(df, ["k"], [F.desc("i")], {"n": F.lit(1), "total": F.col("x")}).collect()}
        alone = {r.i: r.n for r in running(df, [], ["i"], {"n": F.lit(1)}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    n, total, want = defaultdict(int), {}, {}
    for k, i, x in reversed(rows):
        n[k] += 1
        if x is not None:
            total[k] = total.get(k, 0) + x
        want[i] = (n[k], total.get(k))
    assert got == want
    assert alone == {i: i + 1 for i in range(400)}


def test_running_over_nothing(spark):
    df = spark.createDataFrame([], "k string, i int")
    assert running(df, ["k"], ["i"], {"n": F.lit(1)}).collect() == []
