"""Media columns of MPEG audio: a lossless byte store in the frames of an MPEG-1 Layer III stream.

``encode`` lays a payload into the ancillary bytes of silent mono frames at 32 kHz, each with a CRC,
behind an ID3v2 tag (title: the payload's length and SHA-1) and a VBR table (frames, bytes, 100 seek points).
``decode`` assumes nothing about where frames lie: it skips tags, looks for a header that the next
header confirms, checks every CRC, resynchronises after damage, and gives back payload, exact
duration and the offsets of frames. A stream is ``whole`` only if no frame is damaged, nothing was skipped, the
VBR table's frames and bytes are there, and length and digest of the payload are those of the tag (the frames' own
CRCs cover headers and side information alone). ``store`` and ``features`` apply them to a table.

Defined results: null and empty texts store 64 zero bytes; null ids are kept; texts of any length are stored whole;
columns beyond id and text are kept out; repeated rows, equal texts and ties give equal values; an empty table gives
an empty one. A frame with a wrong CRC is counted and its bytes are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches

#: Fixed values of MPEG-1 Layer III: kbit/s by index 1-14, Hz by index 0-2.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
RATE_INDEX = 2
#: Bytes of a frame before the payload: header, CRC, side information of a mono frame.
SIDE = 17
LEAD = 4 + 2 + SIDE
BLOCK = 64
SEEKS = 100


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The CRC of MPEG audio: polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def frame_size(bitrate: int, rate_index: int, padding: int) -> int:
    return 144 * BITRATES[bitrate] * 1000 // RATES[rate_index] + padding


@lru_cache(maxsize=None)
def _lead(bitrate: int) -> bytes:
    """Header, CRC and empty side information of a protected mono frame."""
    header = bytes([0xFF, 0xFA, bitrate << 4 | RATE_INDEX << 2, 0xC0])
    return header + struct.pack(">H", crc16(header[2:] + bytes(SIDE))) + bytes(SIDE)


#: Payload bytes of a frame by bitrate index.
ROOM = [0] + [frame_size(b, RATE_INDEX, 0) - LEAD for b in range(1, 15)]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(title: str) -> bytes:
    body = b"\x00" + title.encode("latin-1")
    frame = b"TIT2" + _synchsafe(len(body)) + b"\x00\x00" + body
    return b"ID3\x04\x00\x00" + _synchsafe(len(frame)) + frame


def encode(payload: bytes) -> bytes:
    largest = ROOM[14]
    full, rest = divmod(len(payload), largest)
    last = next((b for b in range(1, 15) if ROOM[b] >= rest), 14) if rest else 0
    lead = _lead(14)
    frames = [lead + payload[i * largest : (i + 1) * largest] for i in range(full)]
    if rest:
        frames.append(_lead(last) + payload[full * largest :] + bytes(ROOM[last] - rest))
    info_rate = next(b for b in range(1, 15) if ROOM[b] >= 16 + SEEKS)
    sizes = frame_size(info_rate, RATE_INDEX, 0)
    total, count = sizes + sum(map(len, frames)), len(frames)
    whole = frame_size(14, RATE_INDEX, 0)
    seeks = bytes(min(255, 256 * (sizes + min(count * k // SEEKS, full) * whole) // total) for k in range(SEEKS))
    table = b"Xing" + struct.pack(">III", 0x7, count, total) + seeks
    return b"".join([_tag(f"{len(payload)} {hashlib.sha1(payload).hexdigest()}"), _lead(info_rate), table, bytes(ROOM[info_rate] - len(table)), *frames])


@dataclass
class Stream:
    payload: bytes
    frames: int
    damaged: int
    samples: int
    rate: int
    offsets: list[int]
    seeks: bytes | None
    #: Frames and bytes that the VBR table promises.
    promised: tuple[int, int] | None
    title: str | None
    skipped: int
    whole: bool

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _header(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(size, bitrate, protected, lead bytes) of the Layer III frame header at ``at``."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    bitrate, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if not 0 < bitrate < 15 or rate == 3:
        return None
    protected = not data[at + 1] & 1
    side = 17 if data[at + 3] >> 6 == 3 else 32
    return frame_size(bitrate, rate, data[at + 2] >> 1 & 1), RATES[rate], protected, 4 + 2 * protected + side


@lru_cache(maxsize=4096)
def _crc_of(head: bytes) -> int:
    return crc16(head)


def decode(data: bytes) -> Stream:
    at, title = 0, None
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((data[6 + i] & 0x7F) << s for i, s in enumerate((21, 14, 7, 0)))
        inner = 10
        while inner + 10 <= min(10 + size, len(data)) and data[inner : inner + 4].strip(b"\0"):
            n = sum((data[inner + 4 + i] & 0x7F) << s for i, s in enumerate((21, 14, 7, 0)))
            if data[inner : inner + 4] == b"TIT2":
                title = data[inner + 11 : inner + 10 + n].decode("latin-1")
            inner += 10 + n
        at = 10 + size
    begin = at
    out, offsets, seeks, promised = [], [], None, None
    damaged = skipped = rate = 0
    synced = True
    while at + 4 <= len(data):
        found = _header(data, at)
        end = at + found[0] if found else 0
        # out of step, a header counts only if the next one, or the end, follows its frame
        if not found or end > len(data) or not synced and end < len(data) and not _header(data, end):
            nxt = data.find(b"\xff", at + 1)
            nxt = len(data) if nxt < 0 else nxt
            skipped += nxt - at
            at, synced = nxt, False
            continue
        _, hz, protected, lead = found
        good = not protected or _crc_of(data[at + 2 : at + 4] + data[at + 6 : at + lead]) == int.from_bytes(data[at + 4 : at + 6], "big")
        if data[at + lead : at + lead + 4] == b"Xing" and promised is None and not offsets:
            promised = struct.unpack_from(">II", data, at + lead + 8)
            seeks = data[at + lead + 16 : at + lead + 16 + SEEKS]
        else:
            offsets.append(at)
            rate = hz
            damaged += not good
            if good:
                out.append(data[at + lead : end])
        at, synced = end, True
    payload = b"".join(out)
    size, _, digest = (title or "").partition(" ")
    if size.isdigit():
        payload = payload[: int(size)]
    whole = not damaged and not skipped and promised == (len(offsets), at - begin) and size == str(len(payload)) and digest == hashlib.sha1(payload).hexdigest()
    return Stream(payload, len(offsets), damaged, SAMPLES * len(offsets), rate, offsets, seeks, promised, title, skipped, whole)


def payload_of(text: bytes) -> bytes:
    """``text`` with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK or (BLOCK if not text else 0))


_STORED = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Audio streams of the texts as a media column, written in the shared folder and read back."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [b"" if x is None else x for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode(payload_of(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, _STORED), "media")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, frames long, frame_offsets array<long>"


def features(media: DataFrame) -> DataFrame:
    """What the stored streams hold: payload digests, exact duration, frames and where they begin."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = decode(data)
                toc = hashlib.md5(s.seeks or b"").hexdigest()[:8]
                feature = f"frames={s.frames};samples={s.samples};rate={s.rate};crc_errors={s.damaged};skipped={s.skipped};stream={'whole' if s.whole else 'damaged'};toc={toc}"
                rows.append((doc_id, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.seconds, s.frames, s.offsets))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _FEATURES)


_NAMES = [x.split()[0] for x in _FEATURES.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in _FEATURES.split(", ")]


def media_features(docs: DataFrame) -> DataFrame:
    return features(store(docs)).withColumn("seek_points", F.size("frame_offsets").cast("long"))
