"""A corpus from raw documents to packed token sequences, stage by stage.

Each stage takes the table the stage before has left, reads it whole, and returns a table with the columns of
``documents`` (the last one: packed pieces). Between stages the table is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.llm import line_chunks, ngram_join, packing, quality, winnowing
from drawloom.llm.common import public_tokenizer, small_batches, small_side, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the default policy keeps. Null and empty texts have too few words and go."""
    small_batches(spark)
    return quality.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut from the texts; a text of which nothing is left goes, and n_chars follows."""
    rows, added = line_chunks.cut(docs)
    out = rows.filter((F.col(added["n_removed"]) == 0) | F.col("text").isNull() | (F.col("text") != "")).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays; of rows with one id and words,
    the one whose text has the least hash."""
    small_batches(spark)
    found = stored(ngram_join.jaccard_components(docs))
    others = stored(found.filter("component_id != doc_id").select("doc_id").distinct())
    kept = docs.join(small_side(others), "doc_id", "left_anti").select(docs.columns)
    again = stored(found.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    again = small_side(again)
    order = F.struct(F.xxhash64("text"), F.sha2("text", 256))
    least = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*kept.columns), order).alias("_least"))
    once = least.select("_least.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark windows go."""
    return winnowing.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, public_tokenizer("byte_bpe_50k.json"), public_tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("packing", packed),
]

#: Byte-pair encoding, content-defined chunks by Spark's hashes and the packing order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k < len(STAGES) - 1:
            rows = stored(rows)
    return rows
