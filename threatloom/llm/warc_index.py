"""WARC archives with an external index merge.

``write_archives`` stores captures as gzipped WARC/1.1 records, one archive a task, each with a run: a
CDX file sorted by URL key, timestamp and id, with a sparse index of line offsets. ``merge_runs`` cuts
the key space at sampled keys into ranges of a bounded size, and each merge task seeks to its range in every run
and merges the runs with a loser tree, which gives capture histories in global order. Where there are more than
``FAN_IN`` runs, those of a range are merged in groups first. ``read_captures`` follows the merged index back into the
archives.

A cut is a whole key (URL key, timestamp, id), so a URL with any share of the captures is spread over
merge tasks. A payload seen before (equal SHA-1) is stored as a revisit of the record with the smallest
id; the join that finds it is an ordinary equi-join whose hot digests Spark splits at run time. Indexes are read as
streams; a task holds one record, and one line a run.

Defined results: null payloads are empty, null URLs have the empty key, null ids are written as no id and
never referred to while another id has the payload; repeated ids are records of their own, and refer to none if
theirs is the smallest; captures with equal keys keep any order among themselves; payloads of any length are stored
whole; extra columns are never read; an empty table gives empty results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, partitions, shared_dir, small_batches

#: Runs that one task merges at once.
FAN_IN = 256
#: A run's sparse index has an entry for so many lines.
STRIDE = 64
#: Keys that are sampled from all runs together to cut the key space, and captures of a range, about.
SAMPLE = 100_000
RANGE = 1_000_000
NO_ID = -(1 << 63)


def url_key(url: Column) -> Column:
    """The sort-friendly form of a URL: host labels reversed, then path and query, without the scheme."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)"
    host = F.lower(F.regexp_extract(text, pattern, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(text, pattern, 2))
    return F.regexp_replace(F.when(host == "", text).otherwise(key), r"[\t\r\n]", " ")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# records ------------------------------------------------------------------------------------------


def _line(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def record(url: str, stamp: str, payload: bytes, page_id: int | None, refers_to: int | None) -> bytes:
    """A gzipped response, or a revisit if ``refers_to`` is given: that has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Target-URI", _line(url)), ("WARC-Date", date), ("WARC-Record-ID", f"<urn:capture:{'' if page_id is None else page_id}>"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:capture:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    data = "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes) -> dict:
    """Type, ids, digest and payload size of a gzipped record; a response's payload is checked."""
    data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    ident = lambda name: int(x) if (x := fields.get(name, "<urn:capture:>")[13:-1]) else None
    if version != "WARC/1.1" or fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record of {fields.get('WARC-Target-URI')}")
    return {"page_id": ident("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": ident("WARC-Refers-To")}


# runs ---------------------------------------------------------------------------------------------

Key = tuple[bytes, bytes, int]


def _key(line: bytes) -> Key:
    key, stamp, ident, _ = line.split(b"\t", 3)
    return key, stamp, int(ident)


class RunWriter:
    """Writes sorted lines, and the offset of every STRIDE-th one."""

    def __init__(self, fs, root: str, stem: str):
        self.fs, self.root, self.stem = fs, root, stem
        self.out, self.at, self.n, self.sparse = fs.open_output_stream(f"{root}/{stem}.cdx"), 0, 0, array("q")

    def add(self, line: bytes) -> None:
        if self.n % STRIDE == 0:
            self.sparse.append(self.at)
        self.out.write(line)
        self.at += len(line)
        self.n += 1

    def close(self) -> dict:
        self.out.close()
        with self.fs.open_output_stream(f"{self.root}/{self.stem}.sparse", compression=None) as out:
            out.write(self.sparse.tobytes())
        return {"stem": self.stem, "records": self.n}


class Run:
    """A run on disk, of which little is ever in memory."""

    def __init__(self, fs, root: str, stem: str):
        self.lines, self.sparse = fs.open_input_file(f"{root}/{stem}.cdx"), fs.open_input_file(f"{root}/{stem}.sparse")
        self.entries = self.sparse.size() // 8

    def key(self, entry: int) -> tuple[Key, int]:
        """Key and offset of a line of the sparse index."""
        self.sparse.seek(8 * entry)
        (at,) = array("q", self.sparse.read(8))
        self.lines.seek(at)
        line = b""
        while b"\n" not in line and (more := self.lines.read(512)):
            line += more
        return _key(line.partition(b"\n")[0]), at

    def between(self, low: Key | None, high: Key | None) -> Iterator[tuple[Key, bytes]]:
        """Lines with low <= key < high, from the sparse entry before ``low`` on."""
        a, b = 0, self.entries if low else 0  # the first entry whose key is not below low
        while a < b:
            middle = (a + b) // 2
            a, b = (middle + 1, b) if self.key(middle)[0] < low else (a, middle)
        self.lines.seek(self.key(a - 1)[1] if a else 0)
        rest = b""
        while block := self.lines.read(1 << 14):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                key = _key(line)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, line + b"\n"


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next line costs one
    comparison a level."""

    def __init__(self, runs: Iterable[Iterator[tuple[Key, bytes]]]):
        self.runs = list(runs)
        self.heads = [next(r, None) for r in self.runs]
        n = len(self.runs)
        self.losers = [-1] * n
        winners = [-1] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if n > 1 else 0 if n else -1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def __iter__(self) -> Iterator[tuple[Key, bytes]]:
        n = len(self.runs)
        while n and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            node, win = (self.winner + n) // 2, self.winner
            while node:
                if self._before(self.losers[node], win):
                    self.losers[node], win = win, self.losers[node]
                node //= 2
            self.winner = win


# jobs ---------------------------------------------------------------------------------------------


def _stem(kind: str) -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}"


_RUN = "stem string, records long"


def with_revisits(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """captures (url_key, url, stamp, id, payload) with refers_to: the smallest id of an equal payload
    of at least ``least_bytes`` bytes, where that is another record."""
    rows = captures.withColumn("_sha", F.sha1("payload"))
    seen = rows.where(F.octet_length("payload") >= least_bytes).groupBy("_sha").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = rows.join(seen.select("_sha", "_first"), "_sha", "left")
    return rows.select("url_key", "url", "stamp", "id", "payload", F.when((F.octet_length("payload") >= least_bytes) & ~F.col("_first").eqNullSafe(F.col("id")), F.col("_first")).alias("refers_to"))


def write_archives(captures: DataFrame, folder: str) -> list[dict]:
    """Writes archives and their sorted runs; a manifest row (stem, records) for each."""
    small_batches(captures.sparkSession)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        (fs, root), stem = filesystem(folder), _stem("run")
        runs, at = RunWriter(fs, root, stem), 0
        with fs.open_output_stream(f"{root}/{stem}.warc.gz", compression=None) as out:
            for batch in batches:
                for key, url, stamp, ident, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    data = record(url or "", stamp, payload or b"", ident, refers_to)
                    out.write(data)
                    runs.add(f"{key}\t{stamp}\t{NO_ID if ident is None else ident}\t{stem}\t{at}\t{len(data)}\n".encode())
                    at += len(data)
        done = runs.close()
        if done["records"]:
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in done.items()})

    ordered = captures.sortWithinPartitions("url_key", "stamp", F.coalesce("id", F.lit(NO_ID)))
    return [r.asDict() for r in ordered.mapInArrow(run, _RUN).collect()]  # one row an archive


_KEY = "url_key string, stamp string, ident long, weight long"


def _cuts(spark: SparkSession, folder: str, runs: list[dict], ranges: int) -> list[Key]:
    """Keys that cut all captures into about ``ranges`` equal parts, from SAMPLE keys of the runs, one a run at least."""
    each = max(1, SAMPLE // max(1, len(runs)))

    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for stem in batch.column(0).to_pylist():
                own = Run(fs, root, stem)
                step = max(1, -(-own.entries // each))
                found = [own.key(i)[0] for i in range(0, own.entries, step)]
                yield pa.RecordBatch.from_pydict({"url_key": [k[0].decode() for k in found], "stamp": [k[1].decode() for k in found], "ident": [k[2] for k in found], "weight": [step] * len(found)})

    stems = spark.createDataFrame([(r["stem"],) for r in runs], "stem string").repartition(min(len(runs), partitions(spark)))
    keys = sorted(((r["url_key"].encode(), r["stamp"].encode(), r["ident"]), r["weight"]) for r in stems.mapInArrow(run, _KEY).collect())
    total, out, seen = sum(w for _, w in keys), [], 0
    for k, w in keys:
        if seen * ranges >= (len(out) + 1) * total and (not out or k > out[-1]):
            out.append(k)
        seen += w
    return out


def merge_runs(spark: SparkSession, folder: str, runs: list[dict], ranges: int | None = None) -> list[dict]:
    """Merges the runs into one sorted file a key range; manifest rows in key order, with the number of
    captures before each."""

    def merged(jobs: list[tuple[int, list[str], Key | None, Key | None]]) -> list[dict]:
        def run(batches):
            fs, root = filesystem(folder)
            for batch in batches:
                for job in batch.column(0).to_pylist():
                    number, stems, low, high = json.loads(job)
                    low, high = ((x[0].encode(), x[1].encode(), x[2]) if x else None for x in (low, high))
                    out = RunWriter(fs, root, f"{_stem('merged')}-{uuid.uuid4().hex}")
                    for _, line in LoserTree(Run(fs, root, s).between(low, high) for s in stems):
                        out.add(line)
                    yield pa.RecordBatch.from_pydict({"number": [number]} | {k: [v] for k, v in out.close().items()})

        plain = lambda k: k and [k[0].decode(), k[1].decode(), k[2]]
        rows = spark.createDataFrame([(json.dumps([n, s, plain(a), plain(b)]),) for n, s, a, b in jobs], "job string").repartition(max(1, len(jobs)))
        return sorted((r.asDict() for r in rows.mapInArrow(run, "number long, " + _RUN).collect()), key=lambda r: r["number"])

    if not runs:
        return []
    total = sum(r["records"] for r in runs)
    cuts = _cuts(spark, folder, runs, ranges or max(partitions(spark), -(-total // RANGE)))
    parts = len(cuts) + 1

    def job(number: int, low: int, high: int, group: list[list[tuple]]) -> tuple:
        stems = [stem for run in group for begin, end, stem, _ in run if begin < high and end > low]
        return number, stems, cuts[low - 1] if low else None, cuts[high - 1] if high < parts else None

    # a run is a list of files (first range, range after the last, stem, records) in order of their keys
    sorted_runs = [[(0, parts, r["stem"], r["records"])] for r in runs]
    while len(sorted_runs) > FAN_IN:
        # groups of runs become one run each, in as many files as the group has ranges' worth of records
        groups = [sorted_runs[at : at + FAN_IN] for at in range(0, len(sorted_runs), FAN_IN)]
        places = []
        for k, group in enumerate(groups):
            n = max(1, min(parts, parts * sum(f[3] for run in group for f in run) // total))
            places += [(k, parts * i // n, parts * (i + 1) // n) for i in range(n)]
        sorted_runs = [[] for _ in groups]
        for row in merged([job(i, low, high, groups[k]) for i, (k, low, high) in enumerate(places)]):
            k, low, high = places[row["number"]]
            sorted_runs[k].append((low, high, row["stem"], row["records"]))
    out, before = [], 0
    for row in merged([job(i, i, i + 1, sorted_runs) for i in range(parts)]):
        out.append(row | {"before": before})
        before += row["records"]
    return out


_CAPTURE = "rank long, url_key string, stamp string, archive string, offset long, length long"


def capture_histories(spark: SparkSession, folder: str, merged: list[dict]) -> DataFrame:
    """The merged index: captures with their rank in the order of URL key, timestamp and id."""

    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for stem, before in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (line.decode().rstrip("\n").split("\t") for _, line in Run(fs, root, stem).between(None, None))
                while part := list(islice(lines, 5000)):
                    key, stamp, _, archive, offset, length = zip(*part)
                    yield pa.RecordBatch.from_pydict({"rank": list(range(before, before + len(part))), "url_key": key, "stamp": stamp, "archive": archive, "offset": list(map(int, offset)), "length": list(map(int, length))})
                    before += len(part)

    files = spark.createDataFrame([(r["stem"], r["before"]) for r in merged], "stem string, before long")
    return files.repartition(max(1, len(merged))).mapInArrow(run, _CAPTURE)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, history_rank long"


def read_captures(captures: DataFrame, folder: str) -> DataFrame:
    """The records that index rows point at, read from the archives, each archive front to back."""

    def run(batches):
        fs, root = filesystem(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for rank, key, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    name, file = archive, fs.open_input_file(f"{root}/{archive}.warc.gz")
                file.seek(offset)
                rows.append(parse_record(file.read(length)) | {"url_key": key, "history_rank": rank})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_READ_SCHEMA)

    ordered = captures.select("rank", "url_key", "archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, _READ)


_READ_SCHEMA = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in _READ.split(", ")])


def archive_table(pages: DataFrame, stamp: Column, least_bytes: int = 0) -> DataFrame:
    """Stores pages (page_id, url, html), captured at ``stamp`` (yyyyMMddHHmmss), merges the index and
    reads everything back through it."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    captures = pages.select(url_key(pages["url"]).alias("url_key"), pages["url"].alias("url"), stamp.alias("stamp"), pages["page_id"].cast("long").alias("id"), F.coalesce(pages["html"], F.lit("")).cast("binary").alias("payload"))
    runs = write_archives(with_revisits(captures, least_bytes), folder)
    return read_captures(capture_histories(spark, folder, merge_runs(spark, folder, runs)), folder)
