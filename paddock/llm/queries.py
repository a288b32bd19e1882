"""Queries of the training-data operators, thin over the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import bpe, capfilters, chat, contextmix, langid, lexical, linededup, mixing, quality, sharding, simhash, trie, warc
from paddock.llm.common import shared_dir, table, word_count
from paddock.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    done = chat.format_conversations(turns.unionByName(own)).withColumn("turns", chat.read_turns(F.col("formatted")))
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join("removed", ",").alias("removed_lines"),
        word_count(F.col("text")).alias("words_left"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out).withColumn("learn", ~F.col("held_out"))
    found = contextmix.score(docs, "learn", ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    found = warc.resolve(warc.read_archives(spark, path))
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"), "problem"
    )


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = trie.turn_arrays(table(spark, sf_dir, "conversations"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    return trie.trie(trie.rebuilt(held, F.col("conv_id") - F.col("conv_id") % 100, head, 5))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_langid": op5_langid,
    "op6_bpe": op6_bpe,
    "op7_chat": op7_chat,
    "op8_lm": op8_lm,
    "op9_mixing": op9_mixing,
    "op10_embeddings": op10_embeddings,
    "op11_warc": op11_warc,
    "op12_trie": op12_trie,
    "op13_search": op13_search,
}
