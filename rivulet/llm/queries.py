"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import chat, embeddings, media, minhash, mixing, packing, pii, substring, suffix, toxicity
from rivulet.llm.common import read

TOKENIZER = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), F.to_json("spans").alias("spans"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    template = chat.Template()
    back = chat.parse_chats(chat.format_chats(turns.unionByName(extra), template), template)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(masked, lambda s: template.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return back.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The query's SQL rounds weights to a period of 1,000 slots.
    mixed = mixing.mix(read(spark, sf_dir, "documents", "doc_id", "source"), period=1000)
    return mixed.select("doc.doc_id", "doc.source", "block", "slot", "offset")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), k=4)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents", "doc_id", "text"))
    names = F.array(*map(F.lit, pii.KINDS))
    joined = lambda column: F.array_join(F.transform(column, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc.doc_id", *map(count, pii.BASE), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_chat, op3_mixing, op4_embeddings, op5_substring, op6_media, op7_minhash, op8_pii, op9_suffix, op10_packing)}
