"""A corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the one before kept. The first four return the columns of documents; the last returns pieces of
packed sequences. Between stages the documents are written to the shared folder and read again, so a lost executor costs at
most the tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import minhash, mixing, packing, pii, toxicity
from rivulet.llm.common import durable, read


def in_file_order(docs: DataFrame) -> DataFrame:
    """The rows of a table of files in the order of its files' numbers and of the rows within, partition by partition.

    A scan deals out files by size. Other DataFrames have no files and keep the order that they have.
    """
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")
    try:
        placed = docs.select(F.struct("*").alias("doc"), number.alias("number"), name.alias("name"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return docs
    return placed.repartitionByRange("number", "name", "at").sortWithinPartitions("number", "name", "at").select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by the conditional random field stay.

    Null and empty texts have no evidence and stay; repeated rows are scored alike; an empty table, or labels of one kind only,
    reject nothing.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.reject(docs, model, 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 0.8 on five-word shingles stays.

    Texts without words are near nothing and stay; rows without a doc_id stay; equal rows are one document; rows that share a
    doc_id but not a text are looked at each by itself.
    """
    return minhash.keep_first(docs, k=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data becomes its kind in brackets, and n_chars is counted anew.

    A null text stays null, and so does its n_chars.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the order of rows within and across files is the schedule's.

    A null source is a source of its own; rows without a doc_id come first in their source.
    """
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("slot", "offset").sortWithinPartitions("slot", "offset").select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, numbered in the order of the files and their rows.

    Null and empty texts are the end id alone; null and repeated doc_ids are kept row by row; an empty table gives no rows.
    """
    return packing.pack(in_file_order(docs), public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Model scores, exact verification and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
