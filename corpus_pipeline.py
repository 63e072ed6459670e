"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next stage
reads it. All but the last keep the columns of ``docs``. The mix repeats rows of documents that it takes
more than once; the token files hold each of those copies.

Defined results of all stages: extra columns keep their values, whatever their names are, and decide nothing; texts of
any length are read whole; an empty table gives an empty one. Nulls, ties and repeated rows: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threatloom.llm import decontaminate, mixing, near_copies, quality_mil, simhash, token_files
from threatloom.llm.shared import discard, documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored as texts without words; rows that
    repeat an id or a text are decided alike, each by its own text; labels of null ids teach nothing."""
    return quality_mil.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: fingerprints as in ``op4``,
    and texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Texts without words (null, empty, white
    space) are one group; of repeated rows one stays; a row without an id stays only if its group has no row with one;
    texts that share an id stay if their groups differ."""
    return simhash.keep_one(docs, more_links=near_copies.links)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item of five words or more. Null and empty texts contain nothing and stay;
    rows that repeat an id are decided each by its own text; null and empty items are in no document."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them. Texts without words have size 0 and come
    with whole copies of their source alone; a null source is a source; equal chances are drawn in order of id and size; repeated rows are taken each for itself."""
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the token files, null ids first, then by id and text. A
    null or empty text is the end id alone; repeated rows are written each."""
    return token_files.token_table(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("no_benchmark", no_benchmark),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: Fitted models, XXH64 fingerprints and a tokenizer's merges are beyond SQL; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # a stage's table goes when the next one is written
    return docs
