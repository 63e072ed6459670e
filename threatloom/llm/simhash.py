"""SimHash near-duplicates with pigeonring filtering.

Fingerprints have 64 bits: one is set if it is set in over half the XXH64 values (seed 42) of a text's
word shingles, repeats included. Distinct fingerprints link at ``max_bits`` or fewer differing bits;
components of links are groups of near-duplicates.

Pigeonring: seen as a ring of SEGMENTS segments, two linked fingerprints have a segment from which on
every chain of l consecutive segments differs in at most floor(l * max_bits / SEGMENTS) bits. The
longest chains that must not differ at all are the keys of an index with one entry a rotation; in a
bucket, pairs are cut by the budgets of the longer chains, then by the full Hamming distance.

A bucket of over BUCKET fingerprints is split along the ring before anything in it is paired. The chain
behind the key may differ in one bit, so one of its halves is equal: the bucket becomes one bucket a half,
then one a quarter of the other half, and one an eighth. Then 56 of 64 bits are equal, so a bucket holds at
most 256 distinct fingerprints, and pairs grow with fingerprints, never with the square of a group.

Defined results: texts without words (null, empty, white space) have fingerprint zero, linked like any
other; with fewer words than a shingle, the whole sequence is the only shingle; texts of any length are read
whole; component_id is the smallest id reachable; rows without an id link nothing and take the component of their fingerprint, or
null; repeated rows get equal results; extra columns are never read; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, held_by, materialize, small_batches

WIDTH = 3
MAX_BITS = 2
SEED = 42
SEGMENTS = 16
#: Fingerprints of a bucket that are paired; larger buckets are split, SPLITS times at most.
BUCKET = 64
SPLITS = 3

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and the six white space bytes alone
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def simhash(values: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of texts from their shingle hashes."""
    sizes = np.array([len(v) for v in values])
    text = np.repeat(np.arange(len(values)), sizes)
    octets = np.concatenate([np.zeros(0, np.uint64), *values]).astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(values), 8), np.uint8)
    for k in range(8):
        seen = np.bincount(text * 256 + octets[:, k], minlength=256 * len(values)).reshape(-1, 256)
        out[:, k] = np.packbits(2 * (seen @ _BITS) > sizes[:, None], axis=1, bitorder="little")[:, 0]
    return out.view("<u8").reshape(-1)


def _with_fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` of longs and, as the last column, the text: that is replaced by fp, the fingerprint's bits as a long."""
    small_batches(rows.sparkSession)
    names = [*rows.columns[:-1], "fp"]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(names) - 1).cast(pa.large_binary()).to_pylist()
            values = [simhash([shingle_hashes(t or b"", width) for t in texts[i : i + 100]]) for i in range(0, len(texts), 100)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64))], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row."""
    return _with_fingerprints(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), width)


def _rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _mask(start: int, end: int) -> int:
    """Bits start..end of 64, counted from the highest."""
    return (1 << 64 - start) - (1 << 64 - end)


def _budgets(max_bits: int) -> list[tuple[int, int]]:
    """(chain length, bits it may differ in): the longest chain of every budget."""
    budget = {length * max_bits // SEGMENTS: length for length in range(1, SEGMENTS + 1)}
    return sorted((length, bits) for bits, length in budget.items())


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all links between ``nodes`` (fp, node), fp
    being distinct."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    step = 64 // SEGMENTS
    (free, _), *longer = [(n, b) for n, b in _budgets(max_bits)]
    if max_bits == 0:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    turns = F.array(*[F.struct(F.lit(r).alias("turn"), _rotated(F.col("fp"), r * step).alias("ring")) for r in range(SEGMENTS)])
    # (path, mask of the bits that a bucket shares): the key chain, then with halves of what may differ in one bit
    paths = [[(0, ((1 << 64) - (1 << 64 - free * step), longer[0][0] * step, free * step))]]
    while max_bits == 2 and len(paths) <= SPLITS:
        finer = []
        for path, (mask, end, start) in paths[-1]:
            middle = (start + end) // 2
            finer.append((2 * path, (mask | _mask(start, middle), end, middle)))
            finer.append((2 * path + 1, (mask | _mask(middle, end), middle, start)))
        paths.append(finer)

    entries = nodes.select("fp", "node", F.inline(turns)).withColumn("path", F.lit(0))
    found, tables = [], []
    for level, known in enumerate(paths):
        mask = F.element_at(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for _, (m, _, _) in known]), F.col("path") + 1)
        entries = entries.withColumn("chain", F.col("ring").bitwiseAND(mask))
        sizes = entries.groupBy("turn", "path", "chain").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = materialize(entries.join(sizes, ["turn", "path", "chain"]), "simhash-buckets")
        tables.append(shared)
        last = level == len(paths) - 1
        few = (shared if last else shared.where(F.col("n") <= BUCKET)).drop("n")
        other = few.select("turn", "path", "chain", F.col("ring").alias("ring2"), F.col("node").alias("node2"))
        apart = F.col("ring").bitwiseXOR(F.col("ring2"))
        within = F.bit_count(apart) <= max_bits
        for length, bits in longer:
            within = within & (F.bit_count(F.shiftrightunsigned(apart, 64 - length * step) if length < SEGMENTS else apart) <= bits)
        found.append(few.join(other, ["turn", "path", "chain"]).where((F.col("node") < F.col("node2")) & within).select(F.col("node").alias("a"), F.col("node2").alias("b")))
        crowd = shared.where(F.col("n") > BUCKET).select("fp", "node", "turn", "ring", "path")
        if last or crowd.isEmpty():
            break
        entries = crowd.withColumn("path", F.explode(F.array(2 * F.col("path"), 2 * F.col("path") + 1)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = materialize(out.distinct(), "simhash-links")
    discard(*tables)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates between linking larger neighbours to the smallest one and linking smaller neighbours
    to it, until every node hangs on its component's smallest; each round is written to the shared folder.
    """

    def smallest_of(pairs: DataFrame) -> DataFrame:
        """(u, v, m): with the smallest of u and its neighbours."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = edges.where("a < b")
    now, rounds = state(edges), 0
    while now[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = smallest_of(both).where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u > v").distinct()
        small = smallest_of(large)
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v > m").distinct()
        last, edges = edges, materialize(small.select(F.col("m").alias("a"), F.col("v").alias("b")), "components")
        before, now = now, state(edges)
        if rounds:
            discard(last)
        rounds += 1
        if now == before:
            break
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return held_by(out, edges) if rounds else out


def near_duplicates(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = materialize(fingerprints(docs, width), "simhash-prints")
    nodes = materialize(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = components(links(nodes, max_bits))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicate_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id."""
    return near_duplicates(docs, **how).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _keyed_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, fp, n) of every distinct id and text; text_key is a 64-bit hash of the text, n the rows."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), docs["text"])
    return _with_fingerprints(rows, width).groupBy("doc_id", "text_key", "fp").agg(F.count(F.lit(1)).alias("n"))


def keep_one(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS, more_links=None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component, that with the smallest id.
    ``more_links`` makes further edges (a, b) of (node, text), a row a text; they join components too.

    Rows are decided, not ids: rows without an id link like others, and one of them stays only if its
    component has no row with an id; texts that share an id stay if their components differ."""
    rows = materialize(_keyed_fingerprints(docs, width), "simhash-prints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("text_key").alias("node")), "simhash-nodes")
    edges = links(nodes, max_bits)
    if more_links is not None:
        place = rows.select("text_key", "fp").distinct().join(nodes, "fp")
        found = more_links(docs.select(F.xxhash64("text").alias("node"), "text"))
        more = found
        for end in ("a", "b"):  # texts of one fingerprint are one node
            more = more.join(place.select(F.col("text_key").alias(end), F.col("node").alias(f"{end}_node")), end)
        more = more.where("a_node <> b_node").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
        few, edges = edges, materialize(edges.unionByName(more).distinct(), "simhash-more")
        discard(few, found)
    found = components(edges)
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n")).alias("first")
    least = rows.join(classes, "fp").groupBy("component").agg(first)
    kept = materialize(least.select(F.col("first.doc_id").alias("_kept_id"), F.col("first.text_key").alias("_kept_key"), F.col("first.n").alias("_kept_n")), "simhash-kept")
    discard(rows, nodes, edges, found)
    # one plan at every size: the ids grow with the table, so they are never broadcast
    kept = kept.hint("merge")
    same = docs["doc_id"].eqNullSafe(kept["_kept_id"]) & (F.xxhash64(docs["text"]) == kept["_kept_key"])
    out = docs.join(kept, same, "left_semi")
    if kept.where("_kept_n > 1").isEmpty():
        return out
    # rows apart from the names of their columns
    rows = out.select(F.struct(*[out[c] for c in out.columns]).alias("row"), out["doc_id"].alias("id"), F.xxhash64(out["text"]).alias("key"))
    return rows.dropDuplicates(["id", "key"]).select("row.*")
