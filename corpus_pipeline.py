"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudgrid.llm import jaccard_join, langid, packing, pieces, toxicity
from cloudgrid.llm.common import materialise, table
from cloudgrid.llm.words import held_out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose letters are mostly of one learnt language; those without a letter or a main language go."""
    model = langid.fit(docs.where(~held_out("doc_id")))
    return langid.keep_identified(docs, model)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 ids."""
    import public_tokenizers

    model = pieces.read_model(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_digests(docs, model, end_id=2, vocabulary=49408, mode="word")


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicates), ("packing", pack)]
#: Trained models and packing can't be written in SQL; tests hold the stages against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
