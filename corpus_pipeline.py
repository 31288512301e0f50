"""From raw documents to training tokens: the stages, and the run over the whole table.

A stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame. It is written
as Parquet and read again for the next stage, so a lost executor costs one
stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.compression_bands import keep_in_bands
from tabloom.llm.decontaminate import drop_contaminated
from tabloom.llm.mixing import mix
from tabloom.llm.queries import TOKENIZER
from tabloom.llm.registry import table
from tabloom.llm.simhash_dedup import keep_one_of_each
from tabloom.llm.token_files import encode_and_read_back
from tabloom.session import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_in_bands(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, shingle=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row in which a source's budget ends is cut, so lengths are counted anew."""
    mixed = mix(docs)
    if "n_chars" not in docs.columns:
        return mixed
    kind = docs.schema["n_chars"].dataType
    return mixed.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_and_read_back(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]

# zstandard, XXH64 and the tokenizer have no SQL counterpart; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "".join(c if c.isalnum() else "-" for c in name))
    return docs
