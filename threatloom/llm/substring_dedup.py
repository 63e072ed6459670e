"""Substring dedup: words covered by a window of words that also starts in an earlier document go.

Each task rolls Rabin-Karp hashes over every ``width`` consecutive words. What it has seen of a hash
leaves it once, with the smallest document that has it: sorted hashes, cut into buckets by their range
and packed column by column. Spark groups the packs by bucket; there a hash's smallest document decides
for all others. The hashes to remove go back to the rows that hold them (in groups of rows, joined with
their texts), which are hashed once more; overlapping windows merge into maximal intervals.

A hash with any share of all rows costs one entry a block. Blocks, buckets and groups grow as the square root of
the input (``block_size``), so the rows that are exchanged grow as the input. Rows are grouped by a hash of id and
text, so rows that share an id, or have none, are spread. Equality is that of 64-bit hashes: among n distinct
windows a false match is expected n * n / 2**65 times.

Defined results: null and empty texts have no words; a document with fewer words than ``width`` loses
none; texts of any length are read whole; null ids count as later than all others; rows with equal ids are one
document, whose windows never remove each other; extra columns are never read; an empty table gives an empty one.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import block_size, partitions, small_batches

WIDTH = 13
#: Windows that a task gathers before it sends them off, at least, and entries of an exchanged row, on average.
BLOCK = 1 << 20
ROW = 128
LAST = (1 << 63) - 1


def group_of(units: np.ndarray, groups: int) -> np.ndarray:
    return (textops.mix(units.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _by_group(units: np.ndarray, hashes: np.ndarray, groups: int):
    """(group, pack of units, how many hashes each has, and the hashes) of pairs."""
    group = group_of(units, groups)
    order = np.lexsort((units, group))
    units, hashes, group = units[order], hashes[order], group[order]
    for a, b in _runs(group):
        at = [x for x, _ in _runs(units[a:b])]
        yield int(group[a]), textops.pack(units[a:b][at], np.diff(np.r_[at, b - a]), hashes[a:b])


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return list(zip(at.tolist(), np.r_[at[1:], len(values)].tolist()))


def _smallest(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash and document, where each distinct hash begins in it, mask of those in order whose hash a
    smaller document has)."""
    order = np.lexsort((docs, hashes))
    sorted_hashes, sorted_docs = hashes[order], docs[order]
    at = np.flatnonzero(np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1]])
    return order, at, sorted_docs > np.repeat(sorted_docs[at], np.diff(np.r_[at, len(order)]))


def repeated_windows(rows: DataFrame, block: int, groups: int, width: int = WIDTH) -> DataFrame:
    """(_group, _hashes) of rows (unit, doc_id, text): by group of units, packed hashes of windows that an earlier
    document has too."""

    def gather(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        docs: list[np.ndarray] = []
        units: list[np.ndarray] = []
        n = seen = turn = 0

        def flush():
            nonlocal held, docs, units, n, seen, turn
            hashes, row = (np.concatenate(x) for x in zip(*held))
            doc, unit = np.concatenate(docs), np.concatenate(units)
            held, docs, units, n, seen = [], [], [], 0, 0
            order, at, later = _smallest(hashes, doc[row])
            hashes, row = hashes[order], row[order]
            distinct, first = hashes[at], row[at]
            out = []
            for bucket, a, b in textops.bucket_cuts(distinct, groups):
                own, place = np.unique(first[a:b], return_inverse=True)
                out.append((bucket, 0, textops.pack(distinct[a:b], place.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32), doc[own], unit[own])))
            # what this block already shows to be repeated needs no comparing
            for group, packed in _by_group(unit[row[later]], hashes[later], groups):
                out.append((turn % groups, 1, struct.pack("<q", group) + packed))
                turn += 1
            bucket, known, data = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(known, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "known", "data"])

        for batch in batches:
            for at, data, offsets in textops.slices(batch.column(2)):
                words = textops.Words(data, offsets)
                hashes, start = textops.windows(words.hashes(), words.first, width)
                if len(hashes):
                    size = len(offsets) - 1
                    units.append(batch.column(0).slice(at, size).to_numpy())
                    docs.append(batch.column(1).slice(at, size).fill_null(LAST).to_numpy())
                    held.append((hashes, seen + np.searchsorted(words.first, start, "right") - 1))
                    n, seen = n + len(hashes), seen + size
                if n >= block:
                    yield from flush()
        if held:
            yield from flush()

    def decide(table: pa.Table) -> pa.Table:
        out, data = [], table.column("data").to_pylist()
        known = table.column("known").to_pylist()
        parts = [textops.unpack(x) for x, k in zip(data, known) if not k]
        if parts:
            hashes = np.concatenate([h for h, _, _, _ in parts])
            docs, units = (np.concatenate([p[k][p[1]] for p in parts]) for k in (2, 3))
            order, _, later = _smallest(hashes, docs)
            out = list(_by_group(units[order][later], hashes[order][later], groups))
        out += [(struct.unpack_from("<q", x)[0], x[8:]) for x, k in zip(data, known) if k]
        return pa.table({"_group": pa.array([r[0] for r in out], pa.int64()), "_hashes": pa.array([r[1] for r in out], pa.binary())})

    found = rows.mapInArrow(gather, "bucket int, known int, data binary")
    return found.groupBy("bucket").applyInArrow(decide, "_group long, _hashes binary")


_SCHEMA = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first: bigint, last: bigint>>"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by a space) and the removed spans of words."""
    small_batches(docs.sparkSession)
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(F.xxhash64(doc_id, docs["text"]).alias("unit"), doc_id.alias("doc_id"), docs["text"].alias("text"))
    windows = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    block = block_size(windows, BLOCK, ROW)
    groups = max(partitions(docs.sparkSession), -(-windows // block))

    def shrink(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            group = group_of(batch.column(0).to_numpy(), groups)
            packed = pa.array([packer.compress(t or b"") for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(group), *batch.columns[:2], packed], names=["_group", "unit", "doc_id", "_text"])

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        opener = zstandard.ZstdDecompressor()
        known: dict[int, list[np.ndarray]] = {}
        for data in found.column("_hashes").to_pylist():
            units, n, hashes = textops.unpack(data)
            for unit, own in zip(units.tolist(), np.split(hashes, np.cumsum(n)[:-1])):
                known.setdefault(unit, []).append(own)
        rows = []
        for unit, doc_id, packed in zip(*(table.column(c).to_pylist() for c in ("unit", "doc_id", "_text"))):
            text = opener.decompress(packed)
            words = text.split()  # of bytes: exactly at the six white space bytes
            spans: list[tuple[int, int]] = []
            kept = words
            if repeated := known.get(unit):
                own = textops.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                hashes, start = textops.windows(own.hashes(), own.first, width)
                hit = start[np.isin(hashes, np.concatenate(repeated))]
                edges = np.zeros(len(words) + 2, np.int32)
                np.add.at(edges, hit + 1, 1)
                np.add.at(edges, hit + width + 1, -1)
                gone = np.cumsum(edges) > 0  # shifted by one
                turns = np.flatnonzero(gone[1:] != gone[:-1])
                spans = [(int(a), int(b) - 1) for a, b in zip(turns[::2], turns[1::2])]
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b + 1
                kept += words[at:]
            rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept), [{"first": a, "last": b} for a, b in spans]))
        a, b, c, kept, spans = zip(*rows) if rows else ((),) * 5
        return pa.table({"doc_id": pa.array(a, pa.int64()), "n_words": pa.array(b, pa.int64()), "n_removed": pa.array(c, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, _SPAN)})

    packed = rows.mapInArrow(shrink, "_group long, unit long, doc_id long, _text binary")
    return packed.groupBy("_group").cogroup(repeated_windows(rows, block, groups, width).groupBy("_group")).applyInArrow(cut, _SCHEMA)
