"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence_rules import judge

    return judge(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


@query
def op2_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_trie import score

    return score(table(spark, sf_dir, "documents"), 7, 2)


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_diagonals import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_lexicon import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 4, 2, 0.3)


@query
def op5_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mil_quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 5, 0, 0.3)


@query
def op6_credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .credential_links import scan

    return scan(table(spark, sf_dir, "documents"))


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bottomk_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


@query
def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .dac_tokens import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hash_mix import mix

    return mix(table(spark, sf_dir, "documents"), [3, 1, 2], 1.5, 2.0).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bm25_decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rank_profiles import languages

    return languages(table(spark, sf_dir, "documents"), 4, 2)


@query
def op12_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wand_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import digests, periodic_runs, with_period

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(periodic_runs(docs.withColumn("text", with_period(F.col("text"), F.col("doc_id"))), 6, 4))


ORACLE_SQL |= {
    "op1_divergence_rules": oracles.divergence_rules(),
    "op3_license_scan": oracles.license_scan(),
    "op7_near_duplicates": oracles.near_duplicates(),
    "op9_source_mix": oracles.source_mix(),
    "op12_wand_search": oracles.wand_search(),
}
