"""Suffix-array dedup by prefix doubling: bytes covered by a string of ``length`` bytes that also starts elsewhere go.

A prefix of 2 * h bytes at position i is named by the pair of names (i, i + h) of length h; positions whose name is
nobody else's drop out, the others go on until ``length`` is reached. Names of the first lengths (8, 16, ... half of
``length``) are fingerprints, which every task pairs alike without asking others. Then Spark sorts twice:

* Offset half: of all positions in a window of ``length`` bytes one stands for it, that whose name of half the length is the
  smallest. Equal windows have the same one at the same place, so only these positions, one in some fifty, are
  sorted, with the name of all bytes that the windows they stand for cover. A position drops out if nobody shares its
  name; if all who share it also share that of the covered bytes, all their windows are repeated and done.
* Offset ``length - half``: what is left, windows near the ends of repeats, is sorted by the pair of names (i, i + half).

A task sends each name once for a block of positions, and decides for its own what the block shows already, so a
name with any share of all rows costs an entry a block. Sorted names are cut into buckets by range; Spark groups them,
and one bucket reranks its own. Verdicts go back to groups of rows. Blocks, buckets and groups grow as the square root
of the input (``block_size``). Equality is that of 128 bits for covered bytes and of 96 for windows.

Defined results: null and empty texts have no bytes; a text shorter than ``length`` loses none; matches never cross
texts, but a text may repeat itself, with overlaps; rows that repeat id and text are further texts, so they lose
what they share; null ids are kept as null; long texts are read whole, in pieces of bounded memory; extra columns
are never read; an empty table gives an empty one. What is left may end in half a character: it is binary.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import block_size, discard, materialize, partitions, small_batches

LENGTH = 200
#: Positions that a task sorts before it sends them off, at least, and entries of an exchanged row, on average.
BLOCK = 1 << 19
ROW = 128
#: Bytes of text that are named at once; numpy needs some 100 bytes of memory for each.
PIECE = 1 << 18
REPEATED, OPEN = 1, 2
U64 = np.uint64


def names(data: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """The name of the ``length`` bytes (8 at least) from each position on, by prefix doubling; past the end zeros follow."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    out = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))).view("<u8").reshape(-1)
    out, h = textops.mix(out + U64(salt)), 8
    while h < length:
        offset = min(h, length - h)
        far = np.zeros_like(out)
        far[: max(0, len(out) - offset)] = out[offset:]
        out, h = textops.mix(out + textops.mix(far + U64(h + salt))), h + offset
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    out, done = values, 1
    while 2 * done <= width:
        out, done = np.minimum(out[:-done], out[done:]), 2 * done
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - done : width - done + n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number, name of half the length) of stretches of consecutive windows that one position stands for."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(U64)
    half = length // 2
    short = names(data, half)
    least = _smallest(short, length - half + 1)
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - np.arange(len(least)) >= length
    at = np.flatnonzero(room)
    if not len(at):
        return none, none, none.view(U64)
    name = least[at]
    # the next window's position is another one if its name is, or if this window begins with it
    fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (name[1:] != name[:-1]) | (short[at[:-1]] == name[:-1])]
    begin = np.flatnonzero(fresh)
    # smallest names are small numbers: mixed, so that ranges of them are even
    return at[begin], np.diff(np.r_[begin, len(at)]), textops.mix(name[begin] ^ U64(length))


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in that row's text, bytes, offsets): runs of whole texts; long texts come in pieces that
    overlap, so that each window is in one of them."""
    for row, data, offsets in textops.slices(column, PIECE):
        if len(offsets) > 2 or len(data) <= PIECE + length:
            yield row, 0, data, offsets
            continue
        for at in range(0, max(1, len(data) - length + 1), PIECE):
            part = data[at : at + PIECE + length - 1]
            yield row, at, part, np.array([0, len(part)])


def _first(*keys: np.ndarray) -> np.ndarray:
    """Mask of those of sorted keys that differ from the one before."""
    return np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])] if len(keys[0]) else np.zeros(0, bool)


def _sizes(fresh: np.ndarray) -> np.ndarray:
    """For each entry how many its group has."""
    group = np.cumsum(fresh) - 1
    return np.bincount(group)[group] if len(group) else group


def group_of(units: np.ndarray, groups: int) -> np.ndarray:
    return (textops.mix(units.astype(np.int64).view(U64)) % U64(groups)).astype(np.int64)


def _to_rows(units: np.ndarray, places: np.ndarray, verdicts: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(group, pack) of verdicts on places in texts."""
    group = group_of(units, groups)
    order = np.lexsort((places, units, group))
    units, places, verdicts, group = units[order], places[order], verdicts[order], group[order]
    begin = np.flatnonzero(_first(group))
    for a, b in zip(begin, np.r_[begin[1:], len(group)]):
        yield int(group[a]), textops.pack(units[a:b], places[a:b], verdicts[a:b].astype(np.uint8))


def _narrow(places: np.ndarray) -> np.ndarray:
    return places.astype(np.uint32) if not len(places) or places.max() < 1 << 32 else places


_SENT = "bucket int, known boolean, data binary"


class _Block:
    """Entries of one task that are sent off together."""

    def __init__(self, groups: int):
        self.groups, self.turn, self.rows = groups, 0, []

    def known(self, units: np.ndarray, places: np.ndarray, verdicts: np.ndarray) -> None:
        """Verdicts that need no others; dealt over the buckets."""
        for group, data in _to_rows(units, places, verdicts, self.groups):
            self.rows.append((self.turn % self.groups, True, struct.pack("<q", group) + data))
            self.turn += 1

    def send(self, sorted_names: np.ndarray, units: np.ndarray, *columns: np.ndarray) -> None:
        for bucket, a, b in textops.bucket_cuts(sorted_names, self.groups):
            own, place = np.unique(units[a:b], return_inverse=True)
            place = place.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
            self.rows.append((bucket, False, textops.pack(own, place, sorted_names[a:b], *[c[a:b] for c in columns])))

    def batch(self) -> pa.RecordBatch:
        bucket, known, data = zip(*self.rows) if self.rows else ((), (), ())
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(known, pa.bool_()), pa.array(data, pa.binary())], names=["bucket", "known", "data"])


def _decided(found: DataFrame, groups: int, rerank) -> DataFrame:
    """(_group, _verdicts) of what tasks sent: ``rerank`` gets the columns of a bucket, units first, and gives
    (units, places, verdicts)."""

    def decide(table: pa.Table) -> pa.Table:
        data, known = table.column("data").to_pylist(), table.column("known").to_pylist()
        out = [(struct.unpack_from("<q", x)[0], x[8:]) for x, k in zip(data, known) if k]
        parts = [textops.unpack(x) for x, k in zip(data, known) if not k]
        if parts:
            units = np.concatenate([p[0][p[1]] for p in parts])
            columns = [np.concatenate([p[k] for p in parts]) for k in range(2, len(parts[0]))]
            out += _to_rows(*rerank(units, *columns), groups)
        return pa.table({"_group": pa.array([r[0] for r in out], pa.int64()), "_verdicts": pa.array([r[1] for r in out], pa.binary())})

    return found.groupBy("bucket").applyInArrow(decide, "_group long, _verdicts binary")


def _by_position(rows: DataFrame, block: int, groups: int, length: int) -> DataFrame:
    """The first sort: (_group, _verdicts) on stretches of windows of rows (unit, text)."""

    def gather(batches):
        from xxhash import xxh3_64_intdigest

        sent, held, n = _Block(groups), [], 0

        def flush():
            unit, place, name, cover = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((cover, name))
            unit, place, name, cover = unit[order], place[order], name[order], cover[order]
            one, same = _first(name), _first(name, cover)
            alike = _sizes(same) > 1
            kinds = np.add.reduceat(same.astype(np.int64), np.flatnonzero(one))  # different covered bytes of a name
            many = (kinds > 1)[np.cumsum(one) - 1]
            verdict = np.where(alike, REPEATED, 0) | np.where(many & same, OPEN, 0)
            sent.known(unit[verdict > 0], place[verdict > 0], verdict[verdict > 0])
            state = np.where(many, 2, alike)[one].astype(np.uint8)
            sent.send(name[one], unit[one], cover[one], _narrow(place[one]), state)
            return sent.batch()

        for batch in batches:
            units = batch.column(0).to_numpy()
            for row, at, data, offsets in pieces(batch.column(1), length):
                start, number, name = stretches(data, offsets, length)
                if not len(start):
                    continue
                view = memoryview(np.ascontiguousarray(data))
                cover = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), (start + number + length - 1).tolist())), U64, len(start))
                text = np.searchsorted(offsets, start, "right") - 1
                held.append((units[row + text], at + start - offsets[text], name, cover))
                n += len(start)
            if n >= block:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def rerank(units, name, cover, places, state):
        # state: 0 one position in its block, 1 several with the same covered bytes, 2 several kinds, which go on already
        order = np.lexsort((state == 2, cover, name))
        units, name, cover, places, state = units[order], name[order], cover[order], places[order], state[order]
        one, same = _first(name), _first(name, cover)
        begin = np.flatnonzero(one)
        many = ((np.add.reduceat(same.astype(np.int64), begin) > 1) | (np.maximum.reduceat(state, begin) == 2))[np.cumsum(one) - 1]
        verdict = np.where((_sizes(same) > 1) & (state == 0), REPEATED, 0) | np.where(many & same, OPEN, 0)
        keep = (verdict > 0) & (state < 2)
        return units[keep], places[keep], verdict[keep]

    return _decided(rows.mapInArrow(gather, _SENT), groups, rerank)


def _by_window(texts: DataFrame, block: int, groups: int, length: int) -> DataFrame:
    """The second sort: (_group, _verdicts) on windows of the open stretches of ``texts``."""
    half = length // 2

    def gather(batches):
        opener, sent, held, n = zstandard.ZstdDecompressor(), _Block(groups), [], 0

        def flush():
            unit, place, name, more, twice = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((more, name))
            unit, place, name, more, twice = unit[order], place[order], name[order], more[order], twice[order]
            one = _first(name, more)
            alike = _sizes(one) > 1
            known = alike & ~twice
            sent.known(unit[known], place[known], np.full(int(known.sum()), REPEATED))
            at = np.flatnonzero(one)
            sent.send(name[one], unit[one], more[one], _narrow(place[one]), (np.maximum.reduceat(twice.astype(np.uint8), at) if len(at) else twice[one].astype(np.uint8)) | alike[one])
            return sent.batch()

        for batch in batches:
            for unit, packed, opened in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = np.frombuffer(opener.decompress(packed), np.uint8)
                start, number, twice = textops.unpack(opened)
                for a in range(0, len(start), 1024):  # of bounded memory
                    begin, count, sure = start[a : a + 1024].astype(np.int64), number[a : a + 1024].astype(np.int64), twice[a : a + 1024].astype(bool)
                    data = text[textops.ranges(begin, count + length - 1)]
                    fore = np.cumsum(count + length - 1) - (count + length - 1)
                    at = textops.ranges(fore, count)
                    low = names(data, half)
                    name = textops.mix(low[at] + textops.mix(low[at + length - half] + U64(half)))
                    held.append((np.full(len(at), unit), textops.ranges(begin, count), name, (names(data, length, salt=0x51ED)[at] >> U64(32)).astype(np.uint32), np.repeat(sure, count)))
                    n += len(at)
                    if n >= block:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    def rerank(units, name, more, places, twice):
        order = np.lexsort((more, name))
        alike = _sizes(_first(name[order], more[order])) > 1
        keep = order[alike]
        keep = keep[twice[keep] == 0]
        return units[keep], places[keep], np.full(len(keep), REPEATED)

    asked = texts.where("_open IS NOT NULL").select("unit", "_text", "_open")
    return _decided(asked.mapInArrow(gather, _SENT), groups, rerank)


_SCHEMA = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<first: bigint, last: bigint>>"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_TEXTS = "_group long, unit long, doc_id long, _text binary, _done binary, _open binary"


def _verdicts(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """unit -> (places, verdicts), with all verdicts on a place in one."""
    parts = [textops.unpack(x) for x in table.column("_verdicts").to_pylist()]
    if not parts:
        return {}
    units, places, verdicts = (np.concatenate([p[k].astype(np.int64) for p in parts]) for k in range(3))
    order = np.lexsort((places, units))
    units, places, verdicts = units[order], places[order], verdicts[order]
    at = np.flatnonzero(_first(units, places))
    units, places, verdicts = units[at], places[at], np.bitwise_or.reduceat(verdicts, at)
    cuts = np.flatnonzero(_first(units))
    return {int(units[a]): (places[a:b], verdicts[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(units)])}


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (bytes left) and the removed spans of bytes, first and last."""
    if length < 16:
        raise ValueError("length is 16 at least")
    small_batches(docs.sparkSession)
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(F.xxhash64(doc_id, docs["text"]).alias("unit"), doc_id.alias("doc_id"), docs["text"].alias("text"))
    positions = 4 * (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // length
    block = block_size(positions, BLOCK, ROW)
    groups = max(partitions(docs.sparkSession), -(-positions // block))

    def shrink(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            packed = pa.array([packer.compress(t or b"") for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(group_of(batch.column(0).to_numpy(), groups)), *batch.columns[:2], packed], names=["_group", "unit", "doc_id", "_text"])

    def sort_out(table: pa.Table, found: pa.Table) -> pa.Table:
        """Rows with the stretches that are done (start, number) and those that are open (start, number, twice)."""
        opener, verdicts, done, opened = zstandard.ZstdDecompressor(), _verdicts(found), [], []
        for unit, packed in zip(table.column("unit").to_pylist(), table.column("_text").to_pylist()):
            if unit not in verdicts:
                done.append(None)
                opened.append(None)
                continue
            places, verdict = verdicts[unit]
            starts, numbers = [], []
            for _, at, data, offsets in pieces(pa.array([opener.decompress(packed)], pa.large_binary()).cast(pa.large_string()), length):
                start, number, _ = stretches(data, offsets, length)
                starts.append(at + start)
                numbers.append(number)
            start, number = np.concatenate(starts), np.concatenate(numbers)
            number = number[np.searchsorted(start, places)]
            sure, ask = (verdict & REPEATED) > 0, (verdict & OPEN) > 0
            done.append(textops.pack(places[sure], number[sure]) if sure.any() else None)
            opened.append(textops.pack(_narrow(places[ask]), number[ask].astype(np.uint32), sure[ask].astype(np.uint8)) if ask.any() else None)
        return table.append_column("_done", pa.array(done, pa.binary())).append_column("_open", pa.array(opened, pa.binary()))

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        opener, verdicts, out = zstandard.ZstdDecompressor(), _verdicts(found), []
        for unit, doc_id, packed, done in zip(*(table.column(c).to_pylist() for c in ("unit", "doc_id", "_text", "_done"))):
            text = opener.decompress(packed)
            begin, end = (np.zeros(0, np.int64) for _ in "ab")
            if done:
                begin, number = textops.unpack(done)
                end = begin + number + length - 1
            if unit in verdicts:
                places = verdicts[unit][0]
                begin, end = np.r_[begin, places], np.r_[end, places + length]
            spans, kept = [], text
            if len(begin):
                edges = np.zeros(len(text) + 1, np.int32)
                np.add.at(edges, begin, 1)
                np.add.at(edges, end, -1)
                gone = np.r_[False, np.cumsum(edges[:-1]) > 0, False]
                turns = np.flatnonzero(gone[1:] != gone[:-1])
                spans = list(zip(turns[::2].tolist(), (turns[1::2] - 1).tolist()))
                kept = np.frombuffer(text, np.uint8)[~gone[1:-1]].tobytes()
            out.append((doc_id, len(text), len(text) - len(kept), kept, [{"first": a, "last": b} for a, b in spans]))
        a, b, c, kept, spans = zip(*out) if out else ((),) * 5
        return pa.table({"doc_id": pa.array(a, pa.int64()), "n_bytes": pa.array(b, pa.int64()), "n_removed": pa.array(c, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, _SPAN)})

    packed = rows.mapInArrow(shrink, "_group long, unit long, doc_id long, _text binary")
    found = materialize(_by_position(rows.select("unit", "text"), block, groups, length), "suffix-positions")
    texts = materialize(packed.groupBy("_group").cogroup(found.groupBy("_group")).applyInArrow(sort_out, _TEXTS), "suffix-texts")
    discard(found)
    found = materialize(_by_window(texts, block, groups, length), "suffix-windows")
    return texts.groupBy("_group").cogroup(found.groupBy("_group")).applyInArrow(cut, _SCHEMA)
