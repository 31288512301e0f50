"""The corpus operators with their production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import sql
from tabloom.llm.compression_bands import compression_bands
from tabloom.llm.conversation_repair import damage_and_repair
from tabloom.llm.decontaminate import decontaminate
from tabloom.llm.licences import scan_licences
from tabloom.llm.mixing import assign
from tabloom.llm.personal_data import find_personal_data
from tabloom.llm.prefix_trie import prefix_trie
from tabloom.llm.quality_qda import score_quality
from tabloom.llm.registry import QUERIES, SQL, query, table
from tabloom.llm.secrets_grammar import find_secrets
from tabloom.llm.simhash_dedup import near_duplicates
from tabloom.llm.token_files import encode_and_read_back
from tabloom.llm.toxicity import score_toxicity
from tabloom.llm.warc_store import archive_pages, read_records

__all__ = ["QUERIES", "SQL", "TOKENIZER"]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op1_licence_rules")
def _licences(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"))


@query("op2_compression_bands")
def _bands(spark: SparkSession, folder: str) -> DataFrame:
    return compression_bands(table(spark, folder, "documents"))


@query("op3_personal_data")
def _personal(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents")).drop("terms")


@query("op4_mix_sources", sql.MIX_SOURCES)
def _mix(spark: SparkSession, folder: str) -> DataFrame:
    return assign(table(spark, folder, "documents"))


@query("op5_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3)


@query("op6_decontaminate", sql.DECONTAMINATE)
def _decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_simhash_dedup")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=4, distance=4)


@query("op8_quality")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.7)


@query("op9_token_files")
def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_read_back(table(spark, folder, "documents"), TOKENIZER)


@query("op10_secrets")
def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents"))


@query("op11_conversation_repair")
def _repair(spark: SparkSession, folder: str) -> DataFrame:
    return damage_and_repair(table(spark, folder, "conversations"))


@query("op12_warc_store", sql.ARCHIVE_PAGES)
def _warc(spark: SparkSession, folder: str) -> DataFrame:
    return read_records(archive_pages(table(spark, folder, "pages")))


@query("op13_prefix_trie", sql.PREFIX_TRIE)
def _trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))
