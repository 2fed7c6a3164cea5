"""The corpus pipeline: a list of stages over `documents`, each written as
Parquet and read again as the next one's input.

Stages and what they decide. language_id: documents whose language isn't told go.
simhash_near_dedup: one document of each group of near copies stays.
substring_dedup: passages that a document with a lesser key has too are cut out; a
document of which nothing else remains goes. secret_scan: secrets are overwritten.
packing: every chunk of every document gets its place in a sequence; its rows are
doc_id, chunk, n_tokens, sequence_id, first_token. All but the last return the
columns of documents, with n_chars of the text as it then is.

Cases. Nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns are treated as the operators state: a null or empty text has no
language, so its row goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.llm import langid, packing, secrets, simhash, substring
from loomql.llm.common import staged, table, unstage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, docs, F.col("text"), declared=F.col("lang"), host=F.col("source"))
    return langid.keep(docs, model, declared=F.col("lang"), host=F.col("source"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cut(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("packing", pack)]
#: Trained trigrams and tokenizers can't be written in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(before)
    return docs
