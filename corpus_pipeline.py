"""A training corpus from raw documents, in five stages.

Each stage takes the documents that its predecessor kept, written as Parquet
and read again, and all but the last return the columns of ``documents``.

Every stage gives an empty result for an empty table, takes texts of any length
whole, and reads the columns of ``documents`` only, whatever others are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.deploy import ship
from signalweave.llm import chunk_bpe, entropy_mix, ngram_join, pu_quality, superkmer
from signalweave.llm.store import materialize, new_path, sent
from signalweave.operators.running import running

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the positive-unlabelled classifier accepts.

    Null text is scored as empty text.  Rows are judged one by one, by their text
    alone, so rows alike stay or go together, with or without a doc_id.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = pu_quality.train(docs, labels)
    return pu_quality.score(docs, model, keep=COLUMNS).where(F.col("predicted") == 1).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of five-word shingle sets with Jaccard 0.8 or more.

    It is the one with the smallest doc_id, none counting as the largest, and
    among rows of that doc_id the one with the least hash of its text; of rows
    alike in both the least one stays.  Documents without a word are in no class
    and stay.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    rows = materialize(ngram_join.jaccard_classes(docs, n=5, percent=80, keys=True).where(F.col("class_key").isNotNull()), "rows")
    name = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    first = rows.groupBy("class_key").agg(F.min(name).alias("first"))
    counted = rows.groupBy("class_key", "doc_id", "row").agg(F.count(F.lit(1)).alias("n")).join(first, "class_key")
    again = (name == F.col("first")) & (F.col("n") > 1)
    # What goes is less than what stays, and usually few enough to be sent to the texts, which then are not shuffled.
    gone = materialize(counted.where((name != F.col("first")) | again).select(F.col("doc_id").alias("g_doc"), F.col("row").alias("g_row"), again.alias("again")), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("row") == F.col("g_row"))
    texts = docs.withColumn("row", F.xxhash64("text"))
    kept = texts.join(sent(gone.select("g_doc", "g_row")), same, "left_anti")
    repeated = texts.join(sent(gone.where("again").select("g_doc", "g_row")), same, "left_semi")
    one = repeated.groupBy("doc_id", "row").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("one")).select("doc_id", "one.*")
    return kept.select(*COLUMNS).unionByName(one.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 words or more that an earlier document has; documents that keep no word go.

    Earlier is a smaller doc_id, and none counts as the largest; rows of one doc_id,
    or without, take nothing from each other.  Documents that had no word stay as they
    are, null text included, and n_chars becomes that of what is kept.
    """
    ship(spark)
    found = superkmer.remove_repeats(docs, keep=("doc_id", "lang", "source"), texts=True)
    kept = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("bigint").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources meet their target weights.

    Every row has copies of its own, rows that repeat a doc_id, or have none, too.
    Rows alike in doc_id, source and text share their copies as evenly as can be.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    total = F.col("base") * F.col("n") + F.col("ups")
    groups = materialize(entropy_mix.mix_groups(docs).select(F.col("doc_id").alias("c_doc"), F.col("source").alias("c_source"), F.col("row").alias("c_row"), "n", total.alias("total")), "copies").where(F.col("total") > 0)
    keyed = docs.withColumn("row", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("c_doc")) & F.col("source").eqNullSafe(F.col("c_source")) & (F.col("row") == F.col("c_row"))
    each, left = F.floor(F.col("total") / F.col("n")), F.col("total") % F.col("n")
    alike = keyed.join(sent(groups.where(left == 0)), same).withColumn("copies", each)
    # Where the rows of a group differ in copies they are numbered; which of them has which number makes no difference.
    uneven = keyed.join(sent(groups.where(left > 0)), same).withColumn("any_order", F.monotonically_increasing_id())
    numbered = running(uneven, ["c_doc", "c_source", "c_row"], ["lang", "n_chars", "any_order"], {"place": F.lit(1)}, lambda df: materialize(df, "numbered"))
    both = alike.select(*COLUMNS, "copies").unionByName(numbered.withColumn("copies", each + (F.col("place") <= left).cast("bigint")).select(*COLUMNS, "copies"))
    return both.where(F.col("copies") > 0).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document: doc_id, lang, source, n_tokens, ids, and digests of ids and decoded text.

    Null text has no ids.  Repeated rows give repeated rows, with or without a doc_id.
    """
    ship(spark)
    return chunk_bpe.encode_texts(docs, keep=("doc_id", "lang", "source"), texts=True, decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: The first stage learns a model, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
