"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, chat, license_scan, packing, sentencepiece_codec, simhash, suffix_dedup, toxicity, url_filter
from .common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.clips(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_digests(table(spark, sf_dir, "documents"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Messages as a transcript shows them: three in five with a speaker marker, in one of three spellings, chosen by a hash."""
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5))
    name = F.when(F.col("role") == "user", F.when(way == 1, "Human").otherwise("User")).otherwise(F.initcap("role"))
    marker = F.when(way == 0, F.concat(name, F.lit(": "))).when(way == 1, F.concat(F.lit("### "), name, F.lit("\n"))).when(way == 2, F.concat(F.lit("<|"), F.lower(name), F.lit("|> ")))
    line = F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", line.alias("text"), F.col("role").alias("true_role"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, line, true_role, role, begins, marked, rendered, one row per line of the transcripts; role and begins are
    recovered from the lines alone. The model learns from other conversations than those whose crc32(conv_id) mod 3 is 1."""
    raw = transcripts(table(spark, sf_dir, "conversations"))
    learn = raw.where(F.crc32(F.col("conv_id").cast("string")) % 3 != 1).withColumnRenamed("true_role", "role")
    found = chat.decode(chat.lines(raw, ["true_role"]), chat.fit(chat.lines(learn, ["role"])), "true_role")
    return found.drop("body")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_toxicity, op2_simhash, op3_licenses, op4_urls, op5_audio, op6_sentencepiece, op7_packing, op8_suffix_dedup, op9_chat, op10_neighbours)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """Only the license scan can be written in SQL; the others are tested against brute force in tests/llm."""
    return {"op3_licenses": license_scan.scan_sql()}
