"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, jaccard_join, langid, packing, pieces, quality, token_files, toxicity, url_filter, warc
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return pieces.read_model(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(warc.merge(warc.write(table(spark, sf_dir, "pages"))), digest_only=True)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    return url_filter.judge(table(spark, sf_dir, "pages"), [url_filter.PathRule(*r) for r in listed])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2, mode="byte_level")
    return token_files.read_digests(manifest)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_neighbours(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = byte_bpe.serialise(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return byte_bpe.digests(table(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2, vocabulary=49408, mode="word")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_warc, op3_url_filters, op4_token_files, op5_language_id, op6_jaccard_join, op7_toxicity, op8_fingerprints, op9_byte_bpe, op10_packing)}
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality.SQL, "op2_warc": warc.SQL, "op6_jaccard_join": jaccard_join.SQL}
