"""From raw documents to token shards: five stages, each written as Parquet and read again by the next.

Toxic documents go, one document of each group of near-duplicates stays, documents with benchmark items go, sources are
mixed to their weights (a document taken twice stands twice), and what is left is encoded and read back from its shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.bm25_decontam import without_leaks
from graphloom.llm.bottomk_dedup import one_of_each
from graphloom.llm.dac_tokens import encode_documents
from graphloom.llm.hash_mix import mixed_documents
from graphloom.llm.shared import table, written
from graphloom.llm.toxicity_lexicon import without_toxic

#: Path of the tokenizer's file; None: the public tokenizers' byte-level BPE.
TOKENIZER: str | None = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, [3, 1, 2], 1.5, 2.0)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = TOKENIZER
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return encode_documents(docs, path, 2)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix), ("token_shards", token_shards)]

#: The stages learn, hash and tokenize, which SQL cannot express; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
