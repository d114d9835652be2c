"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, contaminated ones go, sources
are mixed, and what is left becomes token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

All stages take any table with the columns of documents: nulls in any column, empty and very long texts, repeated rows, other columns
(they stay, whatever their names), and no rows, which gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.jaccard_join import keep_one
from corpusloom.llm.mixing import mixed
from corpusloom.llm.shared import fresh_path
from corpusloom.llm.token_files import token_file_digest, write_token_files
from corpusloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of less than 0.7. Null and empty texts score as texts without a term; without labels nothing goes."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle sets of five words and a similarity of 0.8: that with the least id, one row of it.

    Texts without a word link with nothing and all stay; rows without an id come last in their group.
    """
    return keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, be it one with an id or not. Null and empty texts stay; without items all rows do."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed as evenly as at most one and a half passes over any of them allow; every document is drawn at least once.

    Null sources are the source ''; rows are drawn each, repeated ones too; equal hashes go by id and size.
    """
    return mixed(docs, entropy=1.0, repetition=1.5, budget=None)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32. Null and empty texts are the end id alone; null ids come first, repeated ones beside each other."""
    out = fresh_path(spark, "pipeline-token-files")
    write_token_files(docs, out, public_tokenizers.path("word_bpe_49k.json"))
    return token_file_digest(spark, out)


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]

#: A trained classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = fresh_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
