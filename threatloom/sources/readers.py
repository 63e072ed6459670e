"""Readers of feeds, files and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE, MAX_TEXT, MIN_PAGE, MAX_PAGE = 2 << 20, 200_000, 200, 400_000
# Fixed values. Extensions of files that are read as text.
TEXT_FILES = r"(?i)\.(txt|csv|tsv|json|jsonl|xml|ya?ml|md|log|ini|env|conf|cfg|html?|js|ts|py|java|go|rb|php|sh|sql|pem|key)$"


def read_feed_lines(spark: SparkSession, paths: str | list[str], order: list[str] | None = None) -> DataFrame:
    """(feed_id, feed_ord, line_no, line) of text files; a feed's id is its folder's or file's name, its
    order that of ``order`` (else of names), line numbers grow along each file."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_n"))
    feed = F.regexp_extract("_path", r"([^/]+?)(?:\.txt)?(?:/part-[^/]*)?$", 1)
    out = lines.select(feed.alias("feed_id"), (F.col("_start") * (1 << 20) + F.col("_n") % (1 << 33)).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("line"))
    names = F.array(*map(F.lit, order)) if order else None
    place = F.array_position(names, F.col("feed_id")).cast("int") - 1 if order else F.lit(0)
    return out.select("feed_id", place.alias("feed_ord"), "line_no", "line")


def read_upload_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, text) of textual files of at most 2 MiB, the first 200 000 characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where((F.col("length") <= MAX_FILE) & F.col("path").rlike(TEXT_FILES))
    return kept.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.substring(F.col("content").cast("string"), 1, MAX_TEXT).alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages (page_id, url, html) of 200 characters or more, the first 400 000 of each."""
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return pages.where(F.length("html") >= MIN_PAGE).withColumn("html", F.substring("html", 1, MAX_PAGE))
