"""The corpus pipeline: documents through five training-data operators, one stage after another.

Every stage takes and, but for the last, returns the columns of ``documents``. Quality rules drop the
documents that they reject and the host's frequent lines from the others; line dedup deletes later
copies of long passages; SimHash near-dedup keeps one document of each group; mixing repeats and cuts documents to the sources' targets; BPE encodes
what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import bpe, linededup, mixing, quality, simhash


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage may have changed it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality.kept_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(linededup.deduped(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as little-endian unsigned 32-bit integers, and a hash of the decoded text."""
    import public_tokenizers

    done = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), [c for c in docs.columns if c != "text"])
    counted = done.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    return counted.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe encoding", encode),
]
#: Fingerprints, seeded draws and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
