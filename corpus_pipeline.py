"""The corpus pipeline: language, exact and near copies, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.bpe import encode
from graphloom.llm.common import fresh_path
from graphloom.llm.exact_dedup import DigestIndex, exact_dedup
from graphloom.llm.language import accepted, fitted
from graphloom.llm.mixing import mixed
from graphloom.llm.near_dedup import without_near_duplicates

#: No SQL expresses learned labels, alignment or merges: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a language; the model is fitted on a bounded sample of docs' own language labels. Null,
    empty and blank texts go; repeated rows stay repeated; an empty table stays empty."""
    return accepted(docs, fitted(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the least id; all null texts count as one, repeated rows as well; a row without an id
    stays only where no other has its text."""
    return exact_dedup(docs, DigestIndex(spark, fresh_path(spark, "index")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the least id. Rows without an id, a text or words are near to
    none and stay; repeated rows are one document and stay."""
    return without_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their sources' smoothed targets ask for; no source gives tokens up. A null source
    is a source like another; null and blank texts stay once."""
    return mixed(docs, exponent=0.9, keep_all=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; a null text has null, an empty one none."""
    return encode(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
