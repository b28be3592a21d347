"""Signals from change history: what changes together, and where repairs gather."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of changes that a task handles together; the pairs of so many are dealt to ``PAIR_TASKS`` tasks.
TASK_ROWS = 1_000_000
PAIR_TASKS = 4


def _tasks(commit_files: DataFrame) -> int | None:
    """Tasks over which changes are dealt, so that none has more of a larger table; none for a table that one task can take."""
    n = -(-commit_files.count() // TASK_ROWS)
    return max(n, commit_files.sparkSession.sparkContext.defaultParallelism) if n > 1 else None


def _bounded_commits(commit_files: DataFrame, max_per_commit: int) -> DataFrame:
    """Distinct (repo, sha, path) of commits with at most so many distinct files.

    The window and the later self-join use the same keys, so one shuffle serves both.
    """
    files = commit_files.select("repo", "sha", "path").distinct()
    counted = files.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("repo", "sha")))
    return counted.where(F.col("_n") <= max_per_commit).drop("_n")


def cochange(commit_files: DataFrame, max_per_commit: int = 30, min_n: int = 2) -> DataFrame:
    """(repo, a, b, n): unordered pairs a < b changed in the same commit at least ``min_n`` times."""
    tasks = _tasks(commit_files)
    dealt = commit_files.repartition(tasks, "repo", "sha") if tasks else commit_files
    files = _bounded_commits(dealt, max_per_commit)
    commits = files.groupBy("repo", "sha").agg(F.sort_array(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)
    left = commits.select("repo", "paths", F.posexplode("paths").alias("_i", "a"))
    pairs = left.select("repo", "a", F.explode(F.expr("slice(paths, _i + 2, size(paths))")).alias("b"))
    if tasks:
        pairs = pairs.repartition(PAIR_TASKS * tasks, "repo", "a", "b")
    return pairs.groupBy("repo", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)


def cochange_totals(commit_files: DataFrame, max_per_commit: int = 30) -> DataFrame:
    """(repo, file, n): commits within the bound that touch a file, single-file commits included."""
    files = _bounded_commits(commit_files, max_per_commit)
    return files.groupBy("repo", F.col("path").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def partners(pairs: DataFrame, totals: DataFrame, k: int = 10, min_n: int = 2) -> DataFrame:
    """(repo, file, partner, n, share): the k files that most often change with each file; ties by name."""
    known = pairs.where(F.col("n") >= min_n)
    sides = F.array(F.struct(F.col("a").alias("file"), F.col("b").alias("partner")), F.struct(F.col("b").alias("file"), F.col("a").alias("partner")))
    both = known.select("repo", "n", F.inline(sides))
    best = Window.partitionBy("repo", "file").orderBy(F.desc("n"), "partner")
    top = both.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    return top.join(totals.withColumnRenamed("n", "_total"), ["repo", "file"]).select("repo", "file", "partner", "n", (F.col("n") / F.col("_total")).alias("share"))
