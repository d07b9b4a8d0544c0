"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import (ann, bpe, decontaminate, html_text, jaccard_join, language_id, pii, quality_rules, substring_dedup,
                           token_counts, token_files, twins, vector_codes, whitening)
from plumbline.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    cache = token_counts.new_cache(shared_dir(spark))
    return token_counts.count_tokens(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", language_id.held_out().alias("held_out"))
    learned = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.identify(docs.drop("lang"), learned).drop("text")


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    files = token_files.new_files(spark)
    token_files.write_files(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), files)
    return token_files.read_digests(spark, files)


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.mark_repeats(table(spark, sf, "documents"), window=20)


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf, "documents")) \
        .select("doc_id", "n_shingles", "component_id", "class_id")


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "documents"))


@query("op8_forest_neighbours")
def op8_forest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_html_text")
def op6_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return html_text.extract(pages, html_text.learn(pages))


@query("op1_benchmark_leaks")
def op1_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_vector_codes", twins.codes())
def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded = vector_codes.with_label_errors(vector_codes.encode(table(spark, sf, "embeddings")))
    code = F.concat(*[F.lpad(F.lower(F.hex(F.col("codes")[p])), 2, "0") for p in range(vector_codes.PARTS)])
    return coded.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings")).select(
        "*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c")) \
        .select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
                F.col("c.explained").alias("explained"), "identity_error")


@query("op12_quality_rules", twins.quality())
def op12_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
