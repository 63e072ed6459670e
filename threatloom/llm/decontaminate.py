"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so a plain MinHash of both would hardly ever agree. Items are
partitioned by size (powers of two), and for each partition a document is seen as half-overlapping
windows of four times the partition's least size: whatever passage holds an item lies in one of them,
and the Jaccard similarity there is bounded from below by the containment sought. From that bound the
rows a band of the partition's index follow. Minima are taken once for the units of the smallest
partition; those of larger windows are minima of minima. A document that collides with an item is
verified: the share of the item's distinct shingles that occur anywhere in the document. Items of fewer than
``SMALLEST`` shingles need no estimate: of a few of their shingles one must occur, so those are looked up.

Words are runs of digits, ASCII letters (A-Z lowered) and all beyond ASCII; shingles have five words.

The items are the stated query set: they are searched in blocks of ``BLOCK`` shingles, each against all documents,
which are scanned once and never shuffled. A worker holds some documents and the index of one block at a time; the
indexes of several blocks are files. Nothing depends on how often a document repeats.

Defined results: null and empty texts contain nothing; texts of any length are searched whole; an item of one to
four words is one shingle, all of them, and is found where they stand in a row, but ``decontaminate`` keeps documents for
its sake, since such words stand in most clean texts; an item without words is never found; null ids are like others; repeated rows give repeated results; extra columns keep their values, whatever their names are, and are
never read; an empty document or benchmark table gives no leaks.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import filesystem, shared_dir, small_batches

WIDTH = 5
LEAST = 0.8
#: Hash functions; chance that a passage at the bound is missed, at most.
HASHES = 32
MISS = 0.005
#: Shingles of the smallest size partition, and of items that are searched at once.
SMALLEST = 8
BLOCK = 2_000_000
#: Bytes of documents that are held while the indexes of several blocks are read.
HELD_BYTES = 64 << 20

_MULTIPLIERS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(column, width: int):
    """(first row, rows, shingle hashes, first shingle of each row)."""
    for at, data, offsets in textops.slices(column):
        words = textops.Words(data, offsets, textops.ALNUM_WORD, lower=True)
        hashes, start = textops.windows(words.hashes(), words.first, width)
        first = np.searchsorted(start, words.first)
        yield at, len(offsets) - 1, hashes, first


def band_rows(least: float, similarity_floor: float) -> int:
    """Most rows a band with which a passage at the floor is missed with a chance below MISS."""
    rows = 1
    if (1 - similarity_floor) ** HASHES > MISS:
        raise ValueError(f"no bands of {HASHES} hashes find {least:.0%} of an item with a chance of {1 - MISS}")
    while rows < 8 and (1 - similarity_floor ** (rows + 1)) ** (HASHES // (rows + 1)) <= MISS:
        rows += 1
    return rows


class Partition:
    """Items of one size, their bands, and the window of documents that they are sought in."""

    def __init__(self, least_size: int, items: list[int], shingles: list[np.ndarray], least: float):
        self.unit = 2 * least_size  # windows are two units: four times the least size
        floor = min(least * n / (2 * self.unit + (1 - least) * n) for n in (least_size, 2 * least_size - 1))
        self.rows = band_rows(least, floor)
        self.bands = HASHES // self.rows
        values = np.array([[(shingles[i] * m).min() for i in items] for m in _MULTIPLIERS])
        self.tables = []
        for b in range(self.bands):
            keys = _band(values, b, self.rows)
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array(items)[order]))


def _band(minima: np.ndarray, band: int, rows: int) -> np.ndarray:
    key = minima[band * rows].copy()
    for r in range(1, rows):
        key = textops.mix(key) + minima[band * rows + r]
    return key


class Index:
    """Size partitions of the items of a block."""

    def __init__(self, ids: list, shingles: list[np.ndarray], least: float):
        self.ids, self.shingles, self.least = ids, shingles, least
        sizes: dict[int, list[int]] = {}
        few: list[tuple[int, int]] = []
        for i, s in enumerate(shingles):
            if len(s) >= SMALLEST:
                sizes.setdefault(1 << int(math.log2(len(s))), []).append(i)
            else:  # one more than may be missing
                few += [(int(x), i) for x in s[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]]
        self.partitions = [Partition(n, sizes[n], shingles, least) for n in sorted(sizes)]
        few.sort()
        self.few = np.array([x for x, _ in few], np.uint64), np.array([i for _, i in few], np.int64)
        self.tiny: dict[int, dict[int, list]] = {}  # by number of words, below a shingle's: hash -> ids

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(row, item) pairs that collide in a band, or in a shingle of a short item."""
        found = [np.zeros((0, 2), np.int64)]
        keys, items = self.few
        if len(hashes) and len(keys):
            low = np.searchsorted(keys, hashes)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == hashes)
            n = np.searchsorted(keys, hashes[hit], "right") - low[hit]
            row = np.searchsorted(first, hit, "right") - 1
            found.append(np.stack([np.repeat(row, n), items[textops.ranges(low[hit], n)]], axis=1))
        if len(hashes) and self.partitions:
            found += self._colliding(hashes, first)
        return np.unique(np.concatenate(found), axis=0)

    def _colliding(self, hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        unit = self.partitions[0].unit
        counts = -(-np.diff(first) // unit)  # units of each row
        row = np.repeat(np.arange(len(counts)), counts)
        begin = np.cumsum(counts) - counts
        starts = first[row] + (np.arange(len(row)) - begin[row]) * unit
        minima = np.stack([np.minimum.reduceat(hashes * m, starts) for m in _MULTIPLIERS])
        found = []
        for p in self.partitions:
            while unit < p.unit:
                inside = np.arange(len(row)) - begin[row]
                even = np.flatnonzero(inside % 2 == 0)
                minima = np.minimum.reduceat(minima, even, axis=1)
                row, unit = row[even], unit * 2
                counts = np.bincount(row, minlength=len(counts))
                begin = np.cumsum(counts) - counts
            pair = minima.copy()
            np.minimum(pair[:, :-1], minima[:, 1:], out=pair[:, :-1], where=row[:-1] == row[1:])
            for b, (keys, items) in enumerate(p.tables):
                key = _band(pair, b, p.rows)
                low = np.searchsorted(keys, key)
                hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == key)
                n = np.searchsorted(keys, key[hit], "right") - low[hit]
                found.append(np.stack([np.repeat(row[hit], n), items[textops.ranges(low[hit], n)]], axis=1))
        return found

    def search(self, column, width: int):
        """(row, item, shared, size) of verified pairs."""
        for at, _, hashes, first in _shingles(column, width):
            pairs = self.candidates(hashes, first)
            cut = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]) if len(pairs) else []
            for group in np.split(pairs, cut[1:]) if len(pairs) else []:
                row = int(group[0, 0])
                own = np.unique(hashes[first[row] : first[row + 1]])
                for item in group[:, 1]:
                    sought = self.shingles[item]
                    shared = int((own[np.minimum(np.searchsorted(own, sought), len(own) - 1)] == sought).sum())
                    if shared >= self.least * len(sought):
                        yield at + row, self.ids[item], shared, len(sought)
        yield from self._search_tiny(column)

    def _search_tiny(self, column):
        for at, data, offsets in textops.slices(column) if self.tiny else ():
            words = textops.Words(data, offsets, textops.ALNUM_WORD, lower=True)
            own = words.hashes()
            for width, sought in self.tiny.items():
                hashes, start = textops.windows(own, words.first, width)
                hit = np.flatnonzero(np.isin(hashes, np.fromiter(sought, np.uint64)))
                rows = np.searchsorted(words.first, start[hit], "right") - 1
                for row, value in sorted(set(zip(rows.tolist(), hashes[hit].tolist()))):
                    for item in sought[value]:
                        yield at + row, item, 1, 1


LEAK = "array<struct<item_id: bigint, shared: bigint, n_shingles: bigint, containment: double>>"
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("n_shingles", pa.int64()), ("containment", pa.float64())]))


def _indexes(items: DataFrame, width: int, least: float, parts: int):
    """The indexes of the items, in ``parts`` blocks by a hash."""
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy(F.col("item_id").asc_nulls_first(), "text").collect()
        texts, ids = pa.array([r["text"] or "" for r in rows], pa.large_string()), [r["item_id"] for r in rows]
        index = Index(ids, [np.unique(h[f[i] : f[i + 1]]) for _, n, h, f in _shingles(texts, width) for i in range(n)], least)
        for at, data, offsets in textops.slices(texts):
            words = textops.Words(data, offsets, textops.ALNUM_WORD, lower=True)
            for n in range(1, width):
                rolled, start = textops.windows(words.hashes(), words.first, n)
                row = np.searchsorted(words.first, start, "right") - 1
                for value, item in zip(rolled[words.counts[row] == n].tolist(), row[words.counts[row] == n].tolist()):
                    index.tiny.setdefault(n, {}).setdefault(value, []).append(ids[at + item])
        yield index


def _placed(spark, indexes, parts: int):
    """A function that gives the indexes one after the other in a worker: a broadcast one, or files in the shared folder."""
    if parts == 1:
        only = spark.sparkContext.broadcast(next(indexes))  # a block of items
        return lambda: iter([only.value])
    folder = shared_dir(spark, "leak-indexes")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    for k, index in enumerate(indexes):
        with fs.open_output_stream(f"{root}/{k}") as out:
            out.write(pickle.dumps(index))

    def read():
        fs, root = filesystem(folder)
        for k in range(parts):
            with fs.open_input_stream(f"{root}/{k}") as data:
                yield pickle.loads(data.read())

    return read


def with_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: float = LEAST, column: str = "_leaks") -> DataFrame:
    """``docs`` with the items that each row contains, in an array column of its own name."""
    spark = docs.sparkSession
    small_batches(spark)
    while column in docs.columns:
        column = "_" + column
    items = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text"))
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (4 * BLOCK)))
    indexes = _placed(spark, _indexes(items, width, least, parts), parts)
    out = docs.withColumn(column, F.array().cast(LEAK))
    place, text = out.columns.index(column), out.columns.index("text")

    def searched(held):
        leaks = [[[] for _ in range(len(batch))] for batch in held]
        for index in indexes():
            for batch, own in zip(held, leaks):
                for row, item, shared, size in index.search(batch.column(text), width):
                    own[row].append({"item_id": item, "shared": shared, "n_shingles": size, "containment": shared / size})
        for batch, own in zip(held, leaks):
            yield pa.RecordBatch.from_arrays([c if i != place else pa.array(own, _LEAK) for i, c in enumerate(batch.columns)], names=batch.schema.names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if parts == 1 or size >= HELD_BYTES:  # several indexes are read once for so many documents
                yield from searched(held)
                held, size = [], 0
        if held:
            yield from searched(held)

    return out.mapInArrow(run, T.StructType(out.schema.fields))


def leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, shared and n_shingles (distinct, of the item) and containment of every leak."""
    found = with_leaks(docs.select("doc_id", "text"), items, **how)
    return found.select("doc_id", F.explode(found.columns[-1]).alias("_leak")).select("doc_id", "_leak.*")


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that contain no item of five words or more."""
    width = how.get("width", WIDTH)
    words = F.regexp_count(F.translate(items["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    found = with_leaks(docs, items.where(words >= width), **how)
    return found.where(F.size(found.columns[-1]) == 0).select(*[found[c] for c in docs.columns])
