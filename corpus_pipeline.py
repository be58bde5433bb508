"""A corpus pipeline: five stages over documents, each written as Parquet and read again before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, language, line_dedup, minhash, mixing, packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, with the predicted one as lang; those that the model rejects (null, empty or without a letter, or
    a score under its calibrated least) go. The model learns from the documents of the stage itself; where there are none to learn
    from, all go. Each row is judged on its own and whole, also where rows repeat or doc_id is null; an empty table stays empty."""
    return language.accepted(docs.select(*COLUMNS), language.learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten of them or more; n_chars follows the text. Every row counts as a document and stays,
    also one that repeats, has a null doc_id or has lost all lines; a null text becomes empty."""
    left = line_dedup.drop_lines(line_dedup.build(docs), docs, keep=("lang", "source"))
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id (null last). Texts without words are like nothing and stay; of
    rows that repeat a doc_id and a text one stays; different texts with one doc_id are different documents."""
    return minhash.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, each partition in the order of the schedule: a document comes once for each whole time that it is taken, and once more with its first words if the
    schedule's last block of its source ends in it. Documents that are not taken go, and so do those without words; a null source is one."""
    return mixing.taken_texts(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the sequence and the offset they are packed at. A document that the mix has several times is packed as
    often: the pieces of each time share a number, copy. A null text gives the end id alone."""
    return packing.packed_documents(docs, numbered=True)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("source_mixing", mix), ("best_fit_packing", pack)]

#: The first and the last stages are a trained model and a search: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.shared_table(docs)
    return docs
