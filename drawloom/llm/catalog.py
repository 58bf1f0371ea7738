"""Queries of the text operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from drawloom.llm import chat_repair, html_blocks, line_chunks, link_graph, ngram_join, packing, periodic_runs, quality, secrets, source_mix, tokens, toxicity, winnowing
from drawloom.llm.common import public_tokenizer, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}  # few: see the README


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scans(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


@query
def op3_benchmark_decontamination(spark, sf_dir):
    rows = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest, winnowing.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


@query
def op4_url_filters(spark, sf_dir):
    return link_graph.judge(table(spark, sf_dir, "pages"))


@query
def op5_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.train_on(pages))


@query
def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_chunks", "text")


@query
def op8_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op9_quality_rules(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"))


@query
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), public_tokenizer("byte_bpe_50k.tiktoken"))


@query
def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.detect(table(spark, sf_dir, "documents"), plant=True)


@query
def op12_source_mix(spark, sf_dir):
    return source_mix.mix(table(spark, sf_dir, "documents"))


ORACLES["op12_source_mix"] = source_mix.MIX_SQL


@query
def op13_conversation_repair(spark, sf_dir):
    return chat_repair.report(table(spark, sf_dir, "conversations"), damage=True)


ORACLES["op13_conversation_repair"] = chat_repair.REPAIR_SQL
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
