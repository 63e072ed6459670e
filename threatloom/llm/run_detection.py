"""Periodic runs of words: maximal stretches that repeat a root several times.

Every run has a Lyndon root (one smaller than all its own rotations), and that is the longest Lyndon prefix of a
suffix under one of two opposite orders of the words. The first phase of Baier's suffix sorter yields just those
prefixes: it sorts suffixes into groups of equal longest Lyndon prefix, the highest group first; each group
appends its prefix to that of the nearest lower suffix before each of its members. Phase one runs under both
orders; prefixes that repeat become roots, and longest common extensions of (i, i + period) to both sides make
them runs.

Only words that can be in a run are sorted: of at least four periods and six words, a run holds no word that isn't in
a triple of words that the text has three times. That test is exact and leaves most of a text out.

A text is one task's work, in linear time and memory; nothing is shuffled.

Defined results: null and empty texts have no words and no runs; texts of any length are read whole; periods and
lengths count words; rows with equal ids or texts are rows like others; extra columns are never read; an empty
table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon prefix of each suffix, by phase one of Baier's suffix sorter; the end is smaller
    than any symbol."""
    n = len(symbols)
    _, group, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    begins = np.cumsum(counts) - counts
    members = dict(zip(begins.tolist(), map(np.ndarray.tolist, np.split(np.argsort(symbols, kind="stable"), begins[1:]))))
    # a group is known by its first place in the order of suffixes; size and prefix length by that place
    size, length, start_of = [0] * n, [1] * n, np.repeat(begins, counts).tolist()
    for b, c in zip(begins.tolist(), counts.tolist()):
        size[b] = c
    group = begins[group].tolist()
    before, out, end = [-1] * n, [0] * n, n
    while end:
        own = start_of[end - 1]
        now = [i for i in members.pop(own) if group[i] == own]
        prefix, times = length[own], {}
        for i in now:
            out[i] = prefix
            p = i - 1
            while p >= 0 and group[p] >= own:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            moved.setdefault((-k, group[p]), []).append(p)
        for (k, old), places in sorted(moved.items()) if len(moved) > 1 else moved.items():
            rest = size[old] - len(places)
            new = old + rest
            if rest:
                for p in places:
                    group[p] = new
                start_of[old + size[old] - 1] = new
                start_of[new - 1] = old
                size[old], size[new] = rest, len(places)
                members[new] = sorted(places)
            length[new] = length[old] - k * prefix
        end = own
    return np.array(out, np.int64)


def extension(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on agree, forwards (step 1) or backwards (-1), i < j."""
    limit = len(words) - j if step > 0 else i + 1
    done, chunk = 0, 16
    while done < limit:
        m = min(chunk, limit - done)
        if step > 0:
            apart = words[i + done : i + done + m] != words[j + done : j + done + m]
        else:
            apart = (words[i - done - m + 1 : i - done + 1] != words[j - done - m + 1 : j - done + 1])[::-1]
        first = int(apart.argmax())
        if apart[first]:
            return done + first
        done, chunk = done + m, 2 * chunk
    return done


def candidates(words: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of stretches whose words are all in triples that occur three times or more; runs lie within."""
    n, kinds = len(words), int(words.max()) + 1 if len(words) else 0
    if n < LEAST_WORDS:
        return []
    pair = words[:-1] * kinds + words[1:]
    if kinds >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, triple, often = np.unique(pair[:-1] * kinds + words[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(often[triple] >= 3)
    if not len(at):
        return []
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 3, -1)
    inside = np.r_[False, np.cumsum(edges[:-1]) > 0, False]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, b) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()) if b - a >= LEAST_WORDS]


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words (numbers, equal for equal words), by start and period."""
    found = set()
    for a, b in candidates(words):
        own = words[a:b]
        for symbols in (own, -own):
            root = lyndon_lengths(symbols)
            place = np.arange(len(own))
            # of four periods a run holds three roots in a row
            again = np.minimum(place + root, len(own) - 1)
            third = np.minimum(again + root, len(own) - 1)
            row = (place + 2 * root < len(own)) & (root[again] == root) & (root[third] == root) & (own[again] == own)
            seen: dict[int, int] = {}  # by period, where the last stretch ends
            for i, p in zip(np.flatnonzero(row).tolist(), root[row].tolist()):
                if i + p <= seen.get(p, 0):
                    continue
                left = extension(own, i - 1, i + p - 1, -1) if i else 0
                size = left + p + extension(own, i, i + p, 1)
                seen[p] = i - left + size
                if size >= max(LEAST_WORDS, LEAST_PERIODS * p):
                    found.add((a + i - left, size, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


_SCHEMA = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the runs by start and period, and collapsed: the words left when each run keeps its first
    period, joined by a space."""
    small_batches(docs.sparkSession)

    def search(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                words = (text or b"").split()  # of bytes: exactly at the six white space bytes
                numbers: dict[bytes, int] = {}
                found = runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
                kept = words
                if found:
                    gone = np.zeros(len(words), bool)
                    for start, length, period in found:
                        gone[start + period : start + length] = True
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                out.append((doc_id, len(words), [{"start": a, "length": b, "period": p} for a, b, p in found], b" ".join(kept)))
            doc_id, n, found, kept = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(found, _RUN), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(search, _SCHEMA)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, the longest run of each text (ties: smallest start, then period) and digests of all runs and of what is left."""
    found = find_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    best = found.withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.col3")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("best.length * 1000 div -best.col3").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
