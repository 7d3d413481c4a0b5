"""Corpus pipeline: quality, exact dedup, near-dedup, source mix, tokens.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``;
the last adds the tokens and each document's place in the mix, since a reread
does not keep the order of rows over several files.
All of them take NULLs in any column, empty and very long texts, ties, repeated
rows, empty tables and extra columns as their operators define it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import exact_dedup, minhash_dedup, quality, sentencepiece_codec, source_mix
from riskframe.llm.common import held_out, read_table, small_batches
from riskframe.llm.queries import PIECE_MODEL
from riskframe.session import checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more; learned from labelled rows that are not held out.

    Without usable labels nothing is known against a document, and all stay.
    """
    small_batches(spark)
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"), "quality", ~held_out(F.col("doc_id"), 3, 1))
    return docs.filter(quality.scorer(model)(F.col("text")) >= 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text that is equal after lower-casing A-Z: the one with the largest id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of texts linked at 0.8 on five-word shingles."""
    return minhash_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in Pfair order of their sources, each source weighted by the square root of its size.

    The order holds inside this stage's files; ``tokens`` finds the same places again for the same rows.
    """
    return source_mix.in_mix_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, with mix_slot, mix_offset and their token ids; ``round_trip`` says that decoding gives the text back.

    Places depend on the ids and sources only, so the reread rows get those of the stage before. They are found and
    sorted before the encoding, which keeps the order of rows. A reader of the result's files sorts by them.
    """
    placed = source_mix.mix_sources(docs).drop("mix_block", "mix_release", "mix_deadline")
    return sentencepiece_codec.encode_documents(placed.orderBy("mix_slot", "mix_offset"), sentencepiece_codec.load_pieces(PIECE_MODEL))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix),
    ("sentencepiece", tokens),
]

#: The classifier and the tokenizer are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared checkpoint folder and read again; rows come in the order of the mix."""
    home = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.orderBy("mix_slot", "mix_offset")
