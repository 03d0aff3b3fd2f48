"""The operators on the given tables with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm import ball_tree, chunks, decontaminate, exact_dedup, language, line_runs, nn_descent, packing, preferences, simhash, spelling, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, oracle: str | None = None):
    def add(query):
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered("op1_packing")
def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@registered("op2_exact_dedup", exact_dedup.ORACLE)
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@registered("op3_chat_format", preferences.ORACLE)
def op3_chat_format(spark, sf_dir):
    turns = preferences.with_other_replies(table(spark, sf_dir, "conversations"))
    rows = preferences.preference_rows(turns, preferences.pairs_of_replies(turns))
    rows = rows.withColumns({c: preferences.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})
    # a pair is a conversation and the one its other reply is from
    return rows.withColumns({"chosen_id": F.col("pair_id"), "rejected_id": F.col("pair_id").bitwiseXOR(F.lit(1).cast("long"))})


@registered("op4_simhash")
def op4_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, max_bits=2)


@registered("op5_language_id")
def op5_language_id(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))


@registered("op6_url_filter", url_filter.ORACLE)
def op6_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


@registered("op7_chunk_dedup")
def op7_chunk_dedup(spark, sf_dir):
    found = chunks.copied_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("from").alias("start"), (F.col("to") - F.col("from")).alias("length"), "words", F.col("first_id").alias("first_doc_id"))


@registered("op8_line_runs", line_runs.ORACLE)
def op8_line_runs(spark, sf_dir):
    return line_runs.line_dedup(table(spark, sf_dir, "documents"), words=line_runs.WORDS)


@registered("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered("op10_decontaminate", decontaminate.ORACLE)
def op10_decontaminate(spark, sf_dir):
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered("op11_spelling", spelling.ORACLE)
def op11_spelling(spark, sf_dir):
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


@registered("op12_ranked_search", ball_tree.ORACLE)
def op12_ranked_search(spark, sf_dir):
    return ball_tree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered("op13_near_vectors")
def op13_near_vectors(spark, sf_dir):
    return nn_descent.near_vectors(table(spark, sf_dir, "embeddings"))
