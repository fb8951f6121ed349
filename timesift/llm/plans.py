"""One registered query for each corpus operator over its whole table, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timesift.llm import (codes, decontaminate, jaccard, language, mixing, neighbours, pages, quality, runs, secrets, sharding, tokens,
                          urls)
from timesift.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlap_digest(decontaminate.find_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.flag_over_limit(tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), 2048)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.label_errors(coded).select("vec_id", "code", "error", "label_error",
                                            F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.run_digest(runs.periodic_runs(docs.select("doc_id", runs.looped_text(F.col("doc_id"), F.col("text")).alias("text"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_permutation_index, op3_host_paths, op4_decontaminate, op5_quality, op6_mix, op7_jaccard,
                                    op8_urls, op9_language, op10_shards, op11_tokens, op12_codes, op13_runs, pipeline)}


def oracles() -> dict[str, str]:
    from timesift.llm.twins import TWINS

    return dict(TWINS)
