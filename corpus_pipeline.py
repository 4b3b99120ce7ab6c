"""A corpus from documents to tokens, stage by stage; every stage's rows are written before the next one reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import bpe, language, line_dedup, mixing, near_dedup
from tandem.llm.common import materialize, read
from tandem.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter in their text) go; the others carry the predicted one."""
    found = language.guessed(docs).filter(F.col("guess.lang_pred") != language.UNKNOWN)
    return found.select(*((F.col("guess.lang_pred") if c == "lang" else F.col("d").getField(c)).alias(c) for c in docs.columns))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the same id are one document, which stays if one of them does; those without an id are in no group."""
    gone = near_dedup.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("any")).filter("NOT any").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text's digest."""
    out = bpe.encode_documents(docs, tokenizer_path())
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("line dedup", remove_repeated_lines),
    ("near dedup", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: Hashes, draws and learned weights have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
