"""Source divergence audit: how far the words of a source are from those of others of its language.

A task lays the texts of a shard end to end, points at the start of every word, and sorts the pointers by multikey
quicksort: eight bytes at a time, in three parts around a pivot; parts that are equal go on with the next eight
bytes. Equal pointers then stand together in the order of their documents, so one pass over the runs gives each
word's count by source and the documents that have it. Spark adds the shards up.

Shares are p = 1 + floor(1e9 * (n + 1) / (N + V)) for a word that occurs n times among a group's N words, V being the
words that the language keeps; divergence is the sum of floor((p - q)^2 / q). For two sources it is summed over all kept
words, though only words that both have are looked at one by one: what a source's words give against a word that
the other lacks comes from a histogram of its shares, and words that neither has all give the same.

Defined results: null texts, languages and sources count as empty; words are runs of ASCII letters and of anything
beyond ASCII, A-Z lower-cased; texts of any length are read whole; every row is a document, repeated rows and ids
too; ties rank by the bytes of source or word; sources without words have ranks like others; extra columns are
never read; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .shared import discard, materialize, small_batches

LEAST_DOCS = 3
TOP = 200
SHARE = 1_000_000_000
#: Words of a shard, about, and pointers that numpy sorts without a further pivot.
SHARD = 2 << 20
SMALL = 1 << 15
#: Pairs of sources that are compared at once.
PAIRS = 1 << 20
LETTERS = textops.byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def _eight(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Bytes depth..depth+7 of words as one big-endian number; what is past a word's end is zero. Eight bytes follow ``data``."""
    rows = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))[np.minimum(starts + depth, len(data) - 8)]
    left = np.clip(sizes - depth, 0, 8).astype(np.uint64)
    key = np.ascontiguousarray(rows).view(">u8").reshape(-1).astype(np.uint64)
    return np.where(left > 0, key >> (np.uint64(64) - np.uint64(8) * np.maximum(left, np.uint64(1))) << (np.uint64(64) - np.uint64(8) * np.maximum(left, np.uint64(1))), np.uint64(0))


def multikey_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words by their bytes, mask of those in order that differ from the one before). Equal words keep
    their order. Words hold no zero byte."""
    data = np.r_[data, np.zeros(8, np.uint8)]
    order, fresh = np.empty(len(starts), np.int64), np.zeros(len(starts), bool)
    stack = [(0, np.arange(len(starts)), 0)] if len(starts) else []
    while stack:
        at, own, depth = stack.pop()
        key = _eight(data, starts[own], sizes[own], depth)
        if len(own) > SMALL:
            pivot = np.sort(key[:: len(key) // 63])[31]
            below, above = key < pivot, key > pivot
            low, mid, high = own[below], own[~(below | above)], own[above]
            if len(low):
                stack.append((at, low, depth))
            if len(high):
                stack.append((at + len(low) + len(mid), high, depth))
            at += len(low)
            if (sizes[mid] > depth + 8).any():
                stack.append((at, mid, depth + 8))
            else:
                order[at : at + len(mid)] = mid
                fresh[at] = True
            continue
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        open_ = (sizes[own] > depth + 8) & ~(new & np.r_[new[1:], True])  # longer words whose first bytes another one has
        while open_.any():
            depth += 8
            run = np.cumsum(new) - 1
            part = np.isin(run, run[open_])
            key = _eight(data, starts[own[part]], sizes[own[part]], depth)
            by = np.lexsort((key, run[part]))
            own[part], key, run = own[part][by], key[by], run[part][by]
            new[part] |= np.r_[True, (key[1:] != key[:-1]) | (run[1:] != run[:-1])]
            open_ = (sizes[own] > depth + 8) & ~(new & np.r_[new[1:], True])
        order[at : at + len(own)], fresh[at : at + len(own)] = own, new
    return order, fresh


def _column(column: pa.Array) -> pa.Array:
    return column.cast(pa.string()).fill_null("")


def shard_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each shard of ``docs`` (lang, source, text): how often, and in how many documents."""
    small_batches(docs.sparkSession)

    def count(batches):
        held, words, langs, sources = [], 0, [], []

        def flush():
            data = np.concatenate([h[0] for h in held])
            shift = np.cumsum([0, *(len(h[0]) for h in held)])
            starts = np.concatenate([h[1] + s for h, s in zip(held, shift)])
            sizes = np.concatenate([h[2] for h in held])
            docs_before = np.cumsum([0, *(h[4] for h in held)])
            doc = np.concatenate([h[3] + s for h, s in zip(held, docs_before)])
            lang, source = (pa.chunked_array(x, pa.string()).combine_chunks().dictionary_encode() for x in (langs, sources))
            lang, source = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lang, source))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            order, fresh = multikey_sort(data, starts, sizes)
            run, doc, begin = np.cumsum(fresh) - 1, doc[order], np.flatnonzero(fresh)
            new_doc = fresh | np.r_[True, doc[1:] != doc[:-1]]
            key = run * (int(group.max()) + 1) + group[doc]
            kinds, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            in_docs = np.bincount(inverse, new_doc).astype(np.int64)
            first = order[begin[kinds // (int(group.max()) + 1)]]  # a pointer to the word
            group = kinds % (int(group.max()) + 1)
            size = sizes[first]
            text = data[textops.ranges(starts[first], size)].tobytes()
            term = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
            columns = [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))), term, pa.array(n), pa.array(in_docs)]
            for a in range(0, len(first), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(a, 1 << 16) for c in columns], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for at, data, offsets in textops.slices(batch.column(2)):
                found = textops.Words(data, offsets, LETTERS, lower=True)
                rows = len(offsets) - 1
                langs.append(_column(batch.column(0).slice(at, rows)))
                sources.append(_column(batch.column(1).slice(at, rows)))
                held.append((found.data, found.starts, found.ends - found.starts, found.text_of(), rows))
                words += len(found)
                if words >= SHARD:
                    yield from flush()
                    held, words, langs, sources = [], 0, [], []
        if words:
            yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(n: Column, of: Column) -> Column:
    """1 + floor(SHARE * (n + 1) / of), exactly."""
    part = F.lit(SHARE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return 1 + F.call_function("div", part, F.greatest(of, F.lit(1)).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared(kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) of words that both of two sources have: their divergence there, less what they would
    have if each of the sources lacked the word, added up by task."""

    def compare(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten()
            source = flat.field("source").dictionary_encode()
            lang = batch.column(0).dictionary_encode()
            names, own = len(source.dictionary), source.indices.to_numpy().astype(np.int64)
            p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            begin = np.cumsum(sizes) - sizes
            language = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes)
            first_of, many = np.repeat(begin, sizes), np.repeat(sizes, sizes)
            totals: dict[int, int] = {}
            ends = np.cumsum(many)
            at = 0
            while at < len(many):  # some entries, each against all of its word
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                g = np.repeat(np.arange(at, end), many[at:end])
                h = textops.ranges(first_of[at:end], many[at:end])
                g, h = g[g != h], h[g != h]
                value = (p[g] - p[h]) ** 2 // p[h] - (p[g] - p0[h]) ** 2 // p0[h] - (p0[g] - p[h]) ** 2 // p[h] + (p0[g] - p0[h]) ** 2 // p0[h]
                pair, inverse = np.unique((language[g] * names + own[g]) * names + own[h], return_inverse=True)
                sums = np.zeros(len(pair), np.int64)
                np.add.at(sums, inverse, value)
                for k, v in zip(pair.tolist(), sums.tolist()):
                    totals[k] = totals.get(k, 0) + v
                at = end
            if totals:
                keys = np.fromiter(totals, np.int64)
                columns = [lang.dictionary.take(pa.array(keys // names // names)), source.dictionary.take(pa.array(keys // names % names)), source.dictionary.take(pa.array(keys % names)), pa.array(list(totals.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])

    lists = kept.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("own")).where(F.size("own") > 1).select("lang", "own")
    return lists.mapInArrow(compare, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: divergence from each other source of the language (``pair``), and the
    ``top`` words that a source has more of than its language (``term``)."""
    docs = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"), docs["text"].alias("text"))
    counts = shard_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")  # at most a row a source
    counts = counts.withColumns({"in_docs": F.sum("docs").over(word), "total": F.sum("n").over(word), "first": F.min("source").over(word) == F.col("source")})
    kept = materialize(counts.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "total", "first"), "divergence-words")

    languages = kept.groupBy("lang").agg(F.sum("n").alias("lang_words"), F.count_if("first").alias("kinds"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("own_kinds"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0)
    groups = materialize(groups.withColumn("p0", _share(F.lit(0).cast("long"), F.col("words") + F.col("kinds"))), "divergence-groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("words") + F.col("kinds")))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own_kinds").alias("item_kinds"))
    histogram = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("times")).join(other, "lang").where("source <> item")

    def given(source: str, item: str, p: str, q: str) -> Column:
        value = F.col("times") * _apart(F.col(p), F.col(q))
        return F.struct(F.col(source).alias("source"), F.col(item).alias("item"), value.alias("value"))

    against = histogram.select("lang", F.inline(F.array(given("source", "item", "p", "q0"), given("item", "source", "q0", "p"))))
    neither = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", ((F.col("kinds") - F.col("own_kinds") - F.col("item_kinds")) * _apart(F.col("p0"), F.col("q0"))).alias("value"))
    pairs = neither.unionByName(against).unionByName(_shared(shares)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    lang_share = _share(F.col("total"), F.col("lang_words") + F.col("kinds"))
    terms = shares.withColumn("q", lang_share).where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))
