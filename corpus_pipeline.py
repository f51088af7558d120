"""Training corpus: from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of `documents`. Rows without
an id pass the second and third stages as they are. A text that loses a passage is its words left, joined by a space, with n_chars counted anew; no document goes for that.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siemloom.llm import byte_bpe, decontaminate, jaccard_join, line_crf, repeats
from siemloom.llm.training import remainder
from siemloom.sources import files

#: A document goes if the classifier's own decision is against it.
LEAST_QUALITY = 0.7
#: Near duplicates: words of a shingle, and per cent of similarity.
SHINGLE, SIMILAR = 5, 80
#: Words of a passage that may stand once.
WINDOW = 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labels that op8 may learn from."""
    model = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(4) == 2)
    return line_crf.with_score(docs, model, least=LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the least id stays; of rows equal in id and text the least one, of rows equal in id alone all."""
    groups = jaccard_join.similar(docs, SHINGLE, SIMILAR)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("stays")).distinct()
    kept = docs.join(stay.hint("shuffle_hash"), docs["doc_id"].cast("long") == stay["stays"], "left_semi")
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    if other:
        least = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*other)).alias("least"))
        kept = least.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"least.`{c}`").alias(c) for c in docs.columns])
    else:
        kept = kept.dropDuplicates()
    return kept.unionByName(docs.where("doc_id IS NULL"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier are cut out."""
    out = repeats.suffix_trees(docs, WINDOW, keep=True)
    column = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept")}
    for c in docs.columns:
        column.setdefault(c, F.col(f"rest.`{c}`"))
    if "n_chars" in docs.columns:
        column["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(column["n_chars"])
    return out.select(*[column[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go."""
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, digests of ids and decoded bytes."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    encoded = byte_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(encoded, "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: The classifier is trained; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again before the next, and removed when the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = files.new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.remove(spark, f"{folder}/{k - 1}")
    return docs
