"""One query for each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalweave.deploy import ship
from signalweave.llm import chunk_bpe, collocations, ecoc_lang, entropy_mix, extendible, mcd_rules, ngram_join, packing, prefix_trie, pu_quality, spotsigs, superkmer, wavelet


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_documents(spark, sf_dir), n=4, percent=85)


def op2_wavelet_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.write_token_shards(_documents(spark, sf_dir))
    return wavelet.read_token_shards(spark, path, tokens=False)


#: Byte limit of a shard in the query.
SHARD_BYTES = 1 << 20


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.assign_shards(_documents(spark, sf_dir), SHARD_BYTES)


def op4_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_texts(_documents(spark, sf_dir), texts=False)


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.pmod(ecoc_lang.crc_of_id(F.col("doc_id")), F.lit(3))
    model = pu_quality.train(docs.where(fold != 1), labels.where(fold != 1))
    scored = pu_quality.score(docs, model)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op6_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.with_next(_documents(spark, sf_dir))


def op7_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    fold = F.pmod(ecoc_lang.crc_of_id(F.col("doc_id")), F.lit(5))
    model = ecoc_lang.train(docs.where(fold != 0))
    found = ecoc_lang.predict(docs, model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = entropy_mix.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mcd_rules.quality_rules(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op10_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.remove_repeats(_documents(spark, sf_dir), texts=False)


def op11_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    turns = prefix_trie.digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    nodes = prefix_trie.trie(*prefix_trie.branched(turns, F.col("conv_id") - F.col("conv_id") % 5, head, most=8))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard_join, op2_wavelet_token_shards, op3_extendible_sharding, op4_chunk_bpe, op5_pu_quality, op6_spotsigs_fingerprints, op7_ecoc_language, op8_entropy_mixing, op9_mcd_quality_rules, op10_superkmer_dedup, op11_bounded_packing, op12_prefix_trie, op13_phrase_collocations]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_join.ORACLE.format(n=4, percent=85),
        "op3_extendible_sharding": extendible.ORACLE.format(limit=SHARD_BYTES),
        "op12_prefix_trie": prefix_trie.ORACLE,
        "op13_phrase_collocations": collocations.ORACLE.format(least=collocations.LEAST, covered=collocations.COVERED, top=collocations.TOP),
        "op10_superkmer_dedup": superkmer.ORACLE.format(k=superkmer.K),
    }
