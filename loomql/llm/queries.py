"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.llm import ann, langid, packing, pieces, secrets, sharding, simhash, substring, tokens, topk
from loomql.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: their label is what they declare, their source their host."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, docs, F.col("text"), declared=F.col("lang"), host=F.col("source"))
    return langid.identify(docs, model, F.col("text"), declared=F.col("lang"), host=F.col("source"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: markup, address suffix and host of their address; trigrams learnt
    from documents."""
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    html = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"&#?\w+;", " ")
    declared = F.regexp_extract(F.col("html"), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    model = langid.fit(pages, docs, text, declared=declared, address=F.col("url"))
    return langid.identify(pages, model, text, declared=declared, address=F.col("url"), id_col="page_id").withColumnRenamed("doc_id", "page_id")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents")).drop("key")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_substring": op3_substring,
    "op4_pieces": op4_pieces,
    "op5_topk": op5_topk,
    "op6_sharding": op6_sharding,
    "op7_tokens": op7_tokens,
    "op8_ann": op8_ann,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
    "page_language": page_language,
}
SQL: dict[str, str] = {"op5_topk": topk.SQL}
