"""Corpus pipeline: documents in, packed training sequences out.

STAGES are applied in order; each takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of documents, with texts and n_chars as they are then.

* toxicity: documents the class-conditional models score at 0.5 or more go.  Labels are learned only
  from rows of which crc32(doc_id) mod 5 is not 0.
* line_dedup: of runs of two lines or more that repeat anywhere in the corpus only the first stays; content-defined
  chunks of a rolling hash find them, windows of two lines what the chunks leave or cut.
* near_dup: of each component of documents linked at 0.8 over five words the smallest doc_id stays;
  rows with a null doc_id are not compared and all stay.
* suffix_dedup: repeated passages of at least 50 words go (PASSAGE_WORDS): the runs of bytes covered by
  strings of 200 bytes (PASSAGE_BYTES, four for each word) that also start elsewhere and that have so many words.
* packing: the texts become pieces of sequences of at most 2048 tokens.

Rows with null or empty texts pass every stage (a document may become empty on the way and keeps its
row); an empty table gives an empty result.  SQL cannot express the stages, so ORACLE_SQL is None and
the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstone.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from linkstone.llm.common import stash

ORACLE_SQL = None
PASSAGE_WORDS, PASSAGE_BYTES, ANCHOR_BYTES = 50, 200, 96


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.tolerable(docs, toxicity.model_for(docs, spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(line_dedup.dedup(docs, runs=True, chunked=True), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = ngram_join.similar(docs.where("doc_id IS NOT NULL")).where("component_id = doc_id").select("doc_id")
    apart = docs.join(stash(kept, "near-dup-kept").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    return apart.unionByName(docs.where("doc_id IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove(docs, length=PASSAGE_BYTES, gram=ANCHOR_BYTES, as_text=True, least_words=PASSAGE_WORDS)
    return _with_text(done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_"))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
