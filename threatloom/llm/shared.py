"""Places that the driver and every executor can reach, and small session helpers."""

from __future__ import annotations

import math
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches
from ..sources.shared import shared_path as shared_dir

__all__ = ["WORD", "ascii_lower", "block_size", "crc_of_id", "discard", "documents", "filesystem", "held_by", "materialize", "partitions", "shared_dir", "small_batches"]

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a Parquet writer holds before it writes them as a row group.
ROW_GROUP = 16 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later jobs neither recompute it nor
    lose it with an executor. The shuffle files behind it go when it is written."""
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def held_by(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which reads ``table`` alone, so that ``discard`` removes the table with it."""
    if path := _written.pop(table, None):
        _written[df] = path
    return df


def discard(*frames: DataFrame) -> None:
    """Removes tables of ``materialize`` that nothing reads any more."""
    for df in frames:
        if path := _written.pop(df, None):
            fs, root = filesystem(path)
            fs.delete_dir(root)


def block_size(total: int, least: int, row: int) -> int:
    """Entries that a task gathers before it deals them into as many buckets as there are such blocks:
    at least ``least``, and so many that the dealt rows hold ``row`` entries on average. Rows thus grow as the
    input, memory and a bucket as its square root."""
    return max(least, math.isqrt(max(0, total) * row))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other alphabets)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text; null ids count as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")))


def filesystem(uri: str):
    """The pyarrow file system and path of a folder, from the driver or from any task."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), uri
