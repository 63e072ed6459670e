"""Links between near copies: texts whose sets of word shingles have a Jaccard similarity of ``LEAST`` or more.

The join is exact (up to equal 64-bit hashes of different shingles). All shingles have one order, rare ones first:
two sets of the similarity sought share a shingle among the first of each, before so many are left out that too few
can still be shared (prefix and positional filter). The order comes from a table of ``COUNTERS`` counts by hash,
whose size doesn't grow with the input; any order is right, a good one keeps passages that many texts share out of
the beginnings. Candidates are verified with their whole sets. Equal texts are one entry from the start.

Most shingles of beginnings are one text's alone. To drop these, a task sends each distinct one of a block of texts
once, packed, and passes on at once what several texts of the block share; a shingle with any share of all texts
costs an entry a block. Only texts of candidate pairs are sent on: a table of bits by hash, of at most
``MOST_BITS``, tells nearly all others apart where they are read, and the join leaves out the rest.

A group of texts with a common beginning is not paired as it stands. First each member is compared with the group's
most typical one (that whose shingles are the most frequent); then members outside that one's component are
compared with members of other components. So links grow with the members of a large group of near copies, and all
pairs that could join components are compared. Texts that share much with each other, but less than ``LEAST``, stay
candidates, and their pairs grow faster than the texts.

Words are those of ``simhash``. Texts without words (null, empty, white space) link nothing here; a text with fewer
words than a shingle has one shingle, all of them; equal rows are one text; texts of any length are read whole; an
empty table has no links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import block_size, discard, materialize, partitions, small_batches
from .simhash import components

WIDTH = 5
LEAST = 0.8
#: Counters of the table of frequencies, and of a row on its way.
COUNTERS = 1 << 20
CHUNK = 1 << 16
#: Shingles that a task gathers before it sends them off, at least, and entries of an exchanged row, on average.
BLOCK = 1 << 20
ROW = 128
#: Bits of the table that tells texts of candidate pairs apart, at most: 32 MB.
MOST_BITS = 28


def _sets(column: pa.Array, width: int):
    """(row, set of shingle hashes, sorted and distinct) of each text with words."""
    for at, data, offsets in textops.slices(column):
        hashes, first = textops.shingles(textops.Words(data, offsets, lower=True), width)
        for i in np.flatnonzero(np.diff(first)).tolist():
            yield at + i, np.unique(hashes[first[i] : first[i + 1]])


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all texts fall to each counter."""
    small_batches(texts.sparkSession)

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, data, offsets in textops.slices(batch.column(0)):
                hashes, _ = textops.shingles(textops.Words(data, offsets, lower=True), width)
                total += np.bincount(_counter(hashes), minlength=COUNTERS)
        if total.any():
            kept = total.astype(np.uint32 if total.max() < 1 << 32 else np.int64)
            chunks = [textops.pack(kept[i : i + CHUNK]) for i in range(0, COUNTERS, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals.setdefault(chunk, np.zeros(CHUNK, np.int64))
                totals[chunk] += textops.unpack(data)[0]
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([textops.pack(t) for t in totals.values()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    rows = texts.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros(COUNTERS, np.int64)
    for r in rows.collect():  # COUNTERS numbers in all
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = textops.unpack(r["counts"])[0]
    return out


def _common(texts: DataFrame, table, width: int, least: float, total: int) -> DataFrame:
    """(shingle, node, size, place, weight) of those shingles in the beginnings of ``texts`` (node, text) that another
    text's beginning has too; size is that of the set, place that in the beginning, weight how frequent its
    shingles are. A row may come from several tasks."""
    block = block_size(total, BLOCK, ROW)
    buckets = max(partitions(texts.sparkSession), -(-total // block))

    def gather(batches):
        firsts, about, seen, n, turn = [], [], set(), 0, 0

        def flush():
            nonlocal turn
            node, size, weight = (np.array(x, t) for x, t in zip(zip(*about), (np.int64, np.int64, np.float64)))
            text = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])
            shingle, place = np.concatenate(firsts), np.concatenate([np.arange(len(f), dtype=np.uint32) for f in firsts])
            order = np.argsort(shingle, kind="stable")
            shingle, text, place = shingle[order], text[order], place[order]
            at = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
            count = np.diff(np.r_[at, len(shingle)])
            rows = []

            def packed(bucket: int, known: bool, entries: np.ndarray, mark: np.ndarray) -> None:
                own, of = np.unique(text[entries], return_inverse=True)
                of = of.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
                rows.append((bucket, known, textops.pack(node[own], size[own], weight[own], of, shingle[entries], place[entries], mark)))

            for bucket, a, b in textops.bucket_cuts(shingle[at], buckets):
                packed(bucket, False, at[a:b], (count[a:b] > 1).astype(np.uint8))
            several = np.flatnonzero(np.repeat(count > 1, count))
            for a in range(0, len(several), 1 << 16):  # dealt over the buckets: nothing about them is open
                packed(turn % buckets, True, several[a : a + (1 << 16)], np.zeros(0, np.uint8))
                turn += 1
            bucket, known, data = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(known, pa.bool_()), pa.array(data, pa.binary())], names=["bucket", "known", "data"])

        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for row, s in _sets(batch.column(1), width):
                if nodes[row] in seen:
                    continue
                seen.add(nodes[row])
                often = table.value[_counter(s)]
                firsts.append(s[np.lexsort((s, often))[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]])
                about.append((nodes[row], len(s), float(often.mean())))
                n += len(firsts[-1])
            if n >= block:
                yield flush()
                firsts, about, seen, n = [], [], set(), 0
        if firsts:
            yield flush()

    def decide(found: pa.Table) -> pa.Table:
        data, known = found.column("data").to_pylist(), found.column("known").to_pylist()
        parts = [(textops.unpack(x), k) for x, k in zip(data, known)]
        node, size, weight = (np.concatenate([p[c][p[3]] for p, _ in parts]) for c in range(3))
        shingle, place = (np.concatenate([p[c] for p, _ in parts]) for c in (4, 5))
        state = np.concatenate([np.full(len(p[4]), 2, np.uint8) if k else p[6] for p, k in parts])  # 2: several here, all sent; 1: its group's first; 0: alone in its block
        keep = state == 2
        asked = np.flatnonzero(state < 2)
        asked = asked[np.lexsort((node[asked], shingle[asked]))]
        if len(asked):
            fresh = np.r_[True, shingle[asked][1:] != shingle[asked][:-1]]
            group, at = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            low, high = node[asked][at], node[asked][np.r_[at[1:], len(asked)] - 1]
            shared = (low != high) | (np.maximum.reduceat(state[asked], at) == 1)
            keep[asked[shared[group] & (state[asked] == 0)]] = True
        columns = (shingle[keep].view(np.int64), node[keep], size[keep], place[keep].astype(np.int64), weight[keep])
        return pa.table(dict(zip(("shingle", "node", "size", "place", "weight"), columns)))

    found = texts.select("node", "text").mapInArrow(gather, "bucket int, known boolean, data binary")
    return found.groupBy("bucket").applyInArrow(decide, "shingle long, node long, size long, place long, weight double")


def _bits(nodes: DataFrame, bits: int) -> np.ndarray:
    """A table of 2 ** bits truth values: whether there is a node with these first bits."""
    chunk = min(1 << bits, CHUNK)

    def mark(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for k in np.unique(slot // chunk).tolist():
                found.setdefault(k, np.zeros(chunk, bool))[slot[slot // chunk == k] % chunk] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for x in found.values()], pa.binary())], names=["chunk", "marks"])

    def unite(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[k] = found.get(k, 0) | np.frombuffer(data, np.uint8)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["chunk", "marks"])

    schema = "chunk int, marks binary"
    out = np.zeros(1 << bits, bool)
    for r in nodes.mapInArrow(mark, schema).repartition("chunk").mapInArrow(unite, schema).collect():  # 2 ** MOST_BITS bits at most
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.unpackbits(np.frombuffer(r["marks"], np.uint8)).astype(bool)
    return np.packbits(out)


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, packed text) of the texts of candidate pairs, and of a few others."""
    count = 2 * pairs.count()
    bits = max(16, min(MOST_BITS, (16 * count).bit_length()))
    marked = texts.sparkSession.sparkContext.broadcast(_bits(pairs.select(F.explode(F.array("a", "b")).alias("node")), bits))  # 32 MB at most

    def run(batches):
        done: set[int] = set()
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            node = batch.column(0).to_numpy()
            slot = (node.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            hit = np.flatnonzero(marked.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            hit = [i for i in hit.tolist() if not (node[i] in done or done.add(node[i]))]
            packed = [packer.compress(batch.column(1)[i].as_py().encode()) for i in hit if batch.column(1)[i].is_valid]
            hit = [i for i in hit if batch.column(1)[i].is_valid]
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(packed, pa.binary())], names=["node", "packed"])

    return materialize(texts.select("node", "text").mapInArrow(run, "node long, packed binary"), "copies-texts")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets have the similarity sought."""

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def shingles(node: int, packed: bytes) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                text = opener.decompress(packed)
                hashes, _ = textops.shingles(textops.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=True), width)
                known[node] = np.unique(hashes)
            return known[node]

        for batch in batches:
            keep = []
            for a, b, of_a, of_b in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = shingles(a, of_a), shingles(b, of_b)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(shared >= least * (len(one) + len(two) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = (texts.dropDuplicates(["node"]).select(F.col("node").alias(n), F.col("packed").alias(f"of_{n}")) for n in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def links(texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all near copies among ``texts`` (node, text)."""
    counts = frequencies(texts, width)
    table = texts.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers
    total = math.ceil((1 - least) * int(counts.sum()))
    entries = materialize(_common(texts, table, width, least, total), "copies-entries")
    groups = entries.groupBy("shingle").agg(F.max(F.struct("weight", "node", "size", "place")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(entries.join(groups, "shingle"), "copies-groups")
    discard(entries)

    def may_link(size: Column, place: Column, size2: Column, place2: Column) -> Column:
        """Whether sets whose first common shingle has these places (from 0) can have the similarity sought."""
        need = (size + size2) * F.lit(least / (1 + least)) - 1e-9
        return (F.least(size, size2) >= F.lit(least) * F.greatest(size, size2)) & (F.least(size - place, size2 - place2) >= need)

    def pair(one: str, two: str) -> list[Column]:
        return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]

    stars = shared.where((F.col("node") != F.col("hub.node")) & may_link(F.col("size"), F.col("place"), F.col("hub.size"), F.col("hub.place"))).select(*pair("node", "hub.node")).distinct()
    stars = materialize(stars, "copies-star-pairs")
    own = _texts_of(stars, texts)
    near = materialize(_verified(stars, own, width, least), "copies-stars")
    discard(own)
    found = components(near)
    # in a group of two both have been compared
    members = shared.where("members > 2").join(found, "node", "left").select("shingle", "node", "size", "place", "weight", F.coalesce("component", "node").alias("component"))
    main = members.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("weight", "node", "component")).alias("hub")).where("low < high").select("shingle", F.col("hub.component").alias("main"))
    members = members.join(main, "shingle")
    rest = members.where("component <> main").drop("weight")
    other = members.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "size", "place", "component")])
    apart = (F.col("component") != F.col("component2")) & ((F.col("component2") == F.col("main")) | (F.col("node") < F.col("node2")))
    cross = rest.join(other, "shingle").where(apart & may_link(F.col("size"), F.col("place"), F.col("size2"), F.col("place2"))).select(*pair("node", "node2")).distinct()
    cross = materialize(cross.join(stars, ["a", "b"], "left_anti"), "copies-cross-pairs")
    own = _texts_of(cross, texts)
    late = _verified(cross, own, width, least)
    out = materialize(near.unionByName(late), "copies-links")
    discard(shared, stars, cross, own, near, found)
    table.unpersist()
    return out
