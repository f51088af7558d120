"""Registered queries of the operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siemloom.llm import block_topk, byte_bpe, decontaminate, jaccard_join, lattice_lm, licences, line_crf, periodic_runs, preferences, repeats, suffix_array, toxicity, whitening
from siemloom.llm.training import remainder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.suffix_trees(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return byte_bpe.digests(byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array.suffix_arrays(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"), 3, 90)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(licences.scan(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(5) == 0
    network = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out)
    out = toxicity.with_score(docs, network)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(4) == 2
    model = line_crf.train(docs, table(spark, sf_dir, "labels"), held_out)
    out = line_crf.with_score(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.pairs_of_conversations(table(spark, sf_dir, "conversations"))
    out = preferences.format_pairs(pairs, "conv_id")
    for c in ("chosen_spans", "rejected_spans"):
        out = out.withColumn(c, F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ","))
    return out


def op10_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return block_topk.top_k(rows, F.col("id") % 20 == 0, 20)


def op11_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = lattice_lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice_lm.score(table(spark, sf_dir, "documents"), model, remainder(5) == 1)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.runs(periodic_runs.with_planted(table(spark, sf_dir, "documents"))))


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_decontaminate, op3_byte_bpe, op4_suffix_array_dedup, op5_jaccard_join, op6_licence_scan, op7_toxicity, op8_quality,
        op9_preference_format, op10_block_topk, op11_lattice_lm, op12_whitening, op13_periodic_runs)}


def all_oracles() -> dict[str, str]:
    return {"op9_preference_format": preferences.SQL, "op10_block_topk": block_topk.SQL}
