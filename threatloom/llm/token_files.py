"""Token-id files: flat unsigned integers in ascending document order, with 64-bit offsets.

``write`` range-partitions the documents by id, and each task encodes its range into one shard:
``<stem>.bin`` holds little-endian unsigned ids (16 bits wide if the vocabulary fits, else 32),
``<stem>.idx`` a header, n + 1 token offsets and n document ids, all 64 bits. Only counts a shard
come back; their prefix sums are the shards' bases, kept in ``manifest.json``. ``read`` maps the
files into memory, one task a shard.

A file is named after the task attempt that wrote it, and the manifest lists the attempts that
succeeded, so retried and speculative tasks leave at most unlisted files.

Ranges are of ids and the beginnings of texts, so rows that share an id, or have none, are spread over shards.

Defined results: null and empty texts hold the end id alone; texts of any length are encoded whole; null ids come
first, repeated ids stand in order of their texts; an empty table gives an empty manifest; extra columns are never
read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, partitions, shared_dir, small_batches

MAGIC = 0x58444E4B54464C54
#: Encoded pieces that a Python worker remembers (about 200 bytes each); later ones are encoded anew.
REMEMBERED = 500_000
#: Characters of a text that its place among the shards depends on, and documents that are read at once.
LEADING = 64
READ_DOCS = 1 << 16
#: A space between two other characters starts a piece of its own in the tokenizers' pattern.
_RUNS = ("  ", "\n\n", " \n", "\n ")
_OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_LETTERS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*%$#&]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def uneven(text: str) -> bool:
    """Whether a text has white space other than single spaces and line ends between other characters."""
    return text[-1:] in (" ", "\n") or any(x in text for x in _RUNS) or any(x in text for x in _OTHER_SPACE)


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    Byte-level tokenizers never join a word with the space-led word behind it, so a text is cut at
    its single spaces and each distinct piece goes through the tokenizer once. Texts with any other
    run of white space, special tokens, and tokenizers of another kind are encoded whole. Single line ends
    are cut likewise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        pre = spec["pre_tokenizer"] or {}
        self.by_piece = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.symbols = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.known: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _word(self, piece: str) -> bytes:
        """A piece that the pattern doesn't split: letters, one run of punctuation, or a line's end."""
        found = self.known.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable():
                symbols = piece.replace(" ", self.symbols[32])
            else:
                symbols = piece.encode().decode("latin-1").translate(self.symbols)
            found = self._pack([t.id for t in self.tokenizer.model.tokenize(symbols)])
            if len(self.known) < REMEMBERED:
                self.known[piece] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if "\n" in piece:  # single ones between other characters: each stands alone, what follows begins anew
            first, *lines = piece.split("\n")
            known, end = self.known.get, self._word("\n")
            return b"".join([(known(first) or self._piece(first)) if first else b"", *(end + (known(x) or self._piece(x)) for x in lines)])
        if m := _LETTERS.fullmatch(piece):
            found = self._word(m[1]) + (self._word(m[2]) if m[2] else b"")
        else:
            found = self._pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(self.known) < REMEMBERED:
            self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if text and (not self.by_piece or uneven(text) or any(x in text for x in self.special)):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        head, *rest = text.split(" ")
        known, piece = self.known.get, self._piece
        return b"".join([known(head) or piece(head)] + [known(p) or piece(p) for p in map(" ".__add__, rest)]) if text else b""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Bytes of text in a shard, about.
SHARD_BYTES = 256 << 20
#: Bytes of text for a byte of a table's files.
PACKED = 2
_SHARD = "shard long, stem string, docs long, tokens long, null_ids long, width long"


def text_bytes(rows: DataFrame, docs: DataFrame) -> int:
    """Bytes of text in ``rows``, about: PACKED times the files of ``docs``, without a scan; a table without files is summed up."""
    folders = {f.rpartition("/")[0] for f in docs.inputFiles()}
    if not folders:
        return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hadoop, conf = docs.sparkSession._jvm.org.apache.hadoop.fs.Path, docs.sparkSession._jsc.hadoopConfiguration()
    return PACKED * sum(hadoop(f).getFileSystem(conf).getContentSummary(hadoop(f)).getLength() for f in folders)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Writes the shards of ``docs`` (doc_id, text) and returns the manifest, also kept in the folder."""
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def run(batches):
        from pyspark import TaskContext

        task, fs_path, enc = TaskContext.get(), filesystem(folder), encoder(tokenizer)
        fs, root = fs_path
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        ids, counts, nulls, end = array("q"), array("q"), 0, enc._pack([end_id])
        with fs.open_output_stream(f"{root}/{stem}.bin") as out:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    encoded = enc.encode(text or "")
                    out.write(encoded)
                    out.write(end)
                    counts.append(len(encoded) // enc.width + 1)
                    ids.append(doc_id or 0)
                    nulls += doc_id is None
        if not ids:
            fs.delete_file(f"{root}/{stem}.bin")
            return
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.frombuffer(counts, np.int64))])
        with fs.open_output_stream(f"{root}/{stem}.idx") as out:
            for part in ([MAGIC, 1, enc.width, len(ids), nulls], offsets, np.frombuffer(ids, np.int64)):
                out.write(np.asarray(part, "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "stem": [stem], "docs": [len(ids)], "tokens": [int(offsets[-1])], "null_ids": [nulls], "width": [enc.width]})

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    leading = F.substring("text", 1, LEADING).asc_nulls_first()
    if shards is None:
        shards = max(partitions(spark), -(-text_bytes(rows, docs) // SHARD_BYTES))
    ranged = rows.repartitionByRange(shards, order[0], leading).sortWithinPartitions(*order)
    found = sorted((r.asDict() for r in ranged.mapInArrow(run, _SHARD).collect()), key=lambda r: r["shard"])  # one row a shard
    at_doc = at_token = 0
    for row in found:
        row |= {"first_doc": at_doc, "first_token": at_token}
        at_doc, at_token = at_doc + row["docs"], at_token + row["tokens"]
    fs, root = filesystem(folder)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(found).encode())
    return found


def open_shard(folder: str, stem: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(token ids, offsets, document ids, null ids among the first of them) of a shard; the ids are
    mapped, not loaded, where the folder is mounted."""
    from pyarrow import fs as pafs

    fs, root = filesystem(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        read = lambda name, dtype: np.memmap(name, dtype, "r")
    else:
        read = lambda name, dtype: np.frombuffer(fs.open_input_file(name).readall(), dtype)
    index = read(f"{root}/{stem}.idx", "<i8")
    if index[0] != MAGIC or index[1] != 1:
        raise ValueError(f"{stem}.idx is not a token index")
    width, n, nulls = map(int, index[2:5])
    return read(f"{root}/{stem}.bin", f"<u{width}"), index[5 : 6 + n], index[6 + n :], nulls


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start among all tokens, n_tokens and crc32 of the ids (as 32-bit integers) from the files."""
    if not manifest:
        return spark.createDataFrame([], _READ)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, offsets, ids, nulls = open_shard(folder, row["stem"])
                for at in range(0, len(ids), READ_DOCS):
                    own, part = ids[at : at + READ_DOCS], offsets[at : at + READ_DOCS + 1]
                    crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(part[:-1].tolist(), part[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=at + np.arange(len(own)) < nulls), pa.array(part[:-1] + row["first_token"], pa.int64()), pa.array(np.diff(part), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = spark.createDataFrame([(r["stem"], r["first_token"]) for r in manifest], "stem string, first_token long")
    return shards.repartition(len(manifest)).mapInArrow(run, _READ)


def token_table(docs: DataFrame, **how) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "tokens")
    return read(docs.sparkSession, folder, write(docs, folder, **how))
