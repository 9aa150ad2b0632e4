"""MPEG audio in a column: frames, tags, variable-bitrate tables, durations and seek offsets."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

# Fixed values of ISO/IEC 11172-3 and 13818-3: kilobits a second by (version 1 or not, layer)
# and index, samples a second by version and index, samples in a frame.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


# Bits of the allocation of each subband in layer II: (subbands, bits) one after the other. By
# version, rate and kilobits a channel: MPEG 2; under 56 at 32 kHz, and at others; 96 and more
# but at 48 kHz; all else.
LSF, LOW_32, LOW, HIGH, MIDDLE = ((4, 4), (7, 3), (19, 2)), ((2, 4), (10, 3)), ((2, 4), (6, 3)), ((11, 4), (12, 3), (7, 2)), ((11, 4), (12, 3), (4, 2))


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    checked: bool
    kbits: int
    rate: int
    mono: bool
    length: int
    bound: int  # the first subband that both channels share

    @property
    def samples(self) -> int:
        return SAMPLES[self.version == 3, self.layer]

    @property
    def side_bytes(self) -> int:
        """Side information of layer III."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    def like(self, other: Header) -> bool:
        """Frames of one stream agree in these."""
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None if they aren't one. Free-format frames don't count."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    kbit, rate, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or kbit in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    bits, hertz, samples = KBITS[version == 3, layer][kbit] * 1000, RATES[version][rate], SAMPLES[version == 3, layer]
    length = (12 * bits // hertz + padding) * 4 if layer == 1 else samples // 8 * bits // hertz + padding
    bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, bits // 1000, hertz, four[3] >> 6 == 3, length, bound)


@lru_cache(maxsize=1 << 14)
def crc16(data: bytes) -> int:
    """The checksum of the standard: polynomial 0x8005, from 0xFFFF."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = value << 1 ^ (0x8005 if value & 0x8000 else 0)
            value &= 0xFFFF
    return value


def _bits(data: bytes, low: int, n: int) -> int:
    """`n` bits from bit `low` on; zeros behind the end."""
    part = data[low // 8 : (low + n + 7) // 8].ljust((low + n + 7) // 8 - low // 8, b"\0")
    return int.from_bytes(part, "big") >> -(low + n) % 8 & (1 << n) - 1


def _protected(data: bytes, h: Header) -> int:
    """How many bits behind the checksum it covers besides the header's: the side information,
    or the bit allocation, in layer II with the selection of scale factors."""
    if h.layer == 3:
        return 8 * h.side_bytes
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return sum(4 * (channels if b < h.bound else 1) for b in range(32))
    each = h.kbits // channels
    if h.version != 3:
        shape = LSF
    elif each < 56:
        shape = LOW_32 if h.rate == 32000 else LOW
    else:
        shape = HIGH if each >= 96 and h.rate != 48000 else MIDDLE
    at = used = 0
    for band, width in enumerate(w for n, w in shape for _ in range(n)):
        for _ in range(channels if band < h.bound else 1):
            used += (_bits(data, at, width) > 0) * (1 if band < h.bound else channels)
            at += width
    return at + 2 * used


def checksum_holds(frame: bytes, h: Header) -> bool:
    """Whether a frame that has a checksum, its third pair of bytes, has the right one."""
    n = _protected(frame[6:], h)
    value = crc16(frame[2:4] + frame[6 : 6 + n // 8])
    for i in range(n // 8 * 8, n):
        value = (value << 1 ^ 0x8005 * ((value >> 15) ^ _bits(frame, 48 + i, 1))) & 0xFFFF
    return value == int.from_bytes(frame[4:6], "big")


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of each audio frame in the file
    bodies: list[tuple[int, int]] = field(default_factory=list)  # main data of each
    samples: int = 0
    rate: int = 0
    kbits: set[int] = field(default_factory=set)
    table: str = ""  # Xing, Info or VBRI
    table_frames: int | None = None
    seek: list[int] = field(default_factory=list)  # of the table: file offsets at even distances in time
    bad_checksums: int = 0
    skipped: int = 0  # bytes passed over to find a frame again

    @property
    def milliseconds(self) -> int:
        """Rounded down; `samples` at `rate` are the exact duration."""
        return self.samples * 1000 // self.rate if self.rate else 0


def _seven_bits(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _text(value: bytes) -> str:
    """Text of a tag frame: the first byte names the encoding."""
    return value[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0] & 3], "replace").strip("\0") if value else ""


def _tags(data: bytes, out: Audio) -> tuple[int, int]:
    """Reads ID3v2 tags; where they end, and where an ID3v1 tag may begin."""
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        sized = _seven_bits if data[at + 3] >= 4 else lambda x: int.from_bytes(x, "big")
        stop, p = min(end, at + 10 + _seven_bits(data[at + 6 : at + 10])), at + 10
        while p + 10 <= stop and data[p]:
            name, size = data[p : p + 4].decode("latin-1"), sized(data[p + 4 : p + 8])
            value = _text(data[p + 10 : min(stop, p + 10 + size)]) if name[0] == "T" else ""
            if name == "TXXX":
                name, _, value = value.partition("\0")
            if value:
                out.tags[name] = value
            p += 10 + size
        at = stop + 10 * bool(data[at + 5] & 0x10)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    return at, end


def _closes(data: bytes, at: int, h: Header) -> bool:
    """Whether the frames from `at` on follow each other up to the last byte."""
    while at < len(data) and (n := header(data[at : at + 4])) is not None and n.like(h):
        at += n.length
    return at == len(data)


def _table(data: bytes, at: int, h: Header, out: Audio) -> bool:
    """Reads a variable-bitrate table, if the frame at `at` is one."""
    p = at + 4 + 2 * h.checked + h.side_bytes
    name = data[p : p + 4]
    if h.layer == 3 and name in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
        values = []
        for flag in (1, 2):
            values.append(int.from_bytes(data[p : p + 4], "big") if flags & flag else None)
            p += 4 * bool(flags & flag)
        out.table, out.table_frames = name.decode(), values[0]
        if flags & 4 and values[1]:
            out.seek = [at + values[1] * x // 256 for x in data[p : p + 100]]
        return True
    p = at + 36
    if data[p : p + 4] == b"VBRI" and len(data) >= p + 26:
        _, _, _, _, frames, entries, scale, width, _ = struct.unpack(">HHHIIHHHH", data[p + 4 : p + 26])
        out.table, out.table_frames, position = "VBRI", frames, at + h.length
        # entries that would lie outside of the frame aren't any
        for i in range(min(entries, (at + h.length - p - 26) // width) if 1 <= width <= 4 else 0):
            out.seek.append(position)
            position += scale * int.from_bytes(data[p + 26 + i * width : p + 26 + (i + 1) * width], "big")
        return True
    return False


def parse(data: bytes) -> Audio:
    """Reads a file. What isn't a frame is skipped; a frame counts if another of its kind, or the end, follows it.

    What looks like an ID3v1 tag is one unless it lies in frames that fill the file to its last byte.
    """
    out = Audio()
    at, end = _tags(data, out)
    first: Header | None = None
    lost = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and end < min(len(data), at + h.length) and (first is None or h.like(first)) and _closes(data, at, h):
            end = len(data)
        fits = h is not None and at + h.length <= end and (first is None or h.like(first))
        if fits and (first is None or lost):
            following = header(data[at + h.length : at + h.length + 4]) if at + h.length < end else h
            fits = following is not None and following.like(h)
        if not fits:
            following = data.find(b"\xff", at + 1, end)
            out.skipped += (following if following >= 0 else end) - at
            lost = True
            if following < 0:
                break
            at = following
            continue
        lost = False
        body = at + 4 + 2 * h.checked + (h.side_bytes if h.layer == 3 else 0)
        if h.checked:
            out.bad_checksums += not checksum_holds(data[at : at + h.length], h)
        if first is None:
            first, out.rate = h, h.rate
            if _table(data, at, h, out):
                at += h.length
                continue
        out.offsets.append(at)
        out.bodies.append((body, at + h.length))
        out.kbits.add(h.kbits)
        out.samples += h.samples
        at += h.length
    if end < len(data):
        for name, low, high in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            out.tags.setdefault(name, data[end + low : end + high].decode("latin-1").strip("\0 "))
    return out


#: Frames that we write: MPEG 1 layer III with checksum, 32 kHz, one channel.
_SIZES = [header(bytes([0xFF, 0xFA, i << 4 | 8, 0xC0])).length for i in range(1, 15)]
_SIDE = bytes(17)
_BODY = 4 + 2 + len(_SIDE)


@lru_cache(maxsize=16)
def _head(kbit: int) -> bytes:
    four = bytes([0xFF, 0xFA, kbit << 4 | 8, 0xC0])
    return four + crc16(four[2:] + _SIDE).to_bytes(2, "big") + _SIDE


def build(payload: bytes, title: str = "") -> bytes:
    """An MPEG file whose frames' main data are `payload`: large frames, then the smallest
    that holds the rest, zeros filling it up. A tag has the payload's length, a table the
    number of frames and seek points."""
    whole, frames = _SIZES[-1] - _BODY, []
    for p in range(0, len(payload), whole):
        part = payload[p : p + whole]
        kbit = next(i for i, size in enumerate(_SIZES, 1) if size - _BODY >= len(part))
        frames.append(_head(kbit) + part.ljust(_SIZES[kbit - 1] - _BODY, b"\0"))
    audio = b"".join(frames)
    kbit = next(i for i, size in enumerate(_SIZES, 1) if size - _BODY >= 116)
    size = _SIZES[kbit - 1] + len(audio)
    full = _SIZES[-1]
    points = bytes(min(255, (_SIZES[kbit - 1] + full * (i * len(frames) // 100)) * 256 // size) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), size) + points
    texts = b""
    for name, value in (("TXXX", f"payload\0{len(payload)}"), ("TIT2", title)):
        if value:
            coded = b"\3" + value.encode()
            texts += name.encode() + _spread(len(coded)) + b"\0\0" + coded
    return b"ID3\4\0\0" + _spread(len(texts)) + texts + (_head(kbit) + xing).ljust(_SIZES[kbit - 1], b"\0") + audio


def _spread(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def payload_of(data: bytes, audio: Audio) -> bytes:
    """What `build` was given; of a file that `build` didn't write, the main data of all frames."""
    n = audio.tags.get("payload", "")
    return b"".join(data[a:b] for a, b in audio.bodies)[: int(n) if re.fullmatch("[0-9]{1,18}", n) else None]


def feature(audio: Audio) -> str:
    """Samples and their rate, frames, bitrates, table and a digest of the seek offsets."""
    seek = zlib.crc32(struct.pack(f"<{len(audio.offsets)}Q", *audio.offsets))
    return f"{audio.samples}/{audio.rate}Hz/{len(audio.offsets)}f/{min(audio.kbits, default=0)}-{max(audio.kbits, default=0)}k/{audio.table}:{audio.table_frames}/bad{audio.bad_checksums}/skip{audio.skipped}/{seek:08x}"


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes with zeros up to a positive multiple of 64, as an MPEG file. Null is empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            files = [build(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(task, f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


MEDIA_COLUMNS = {"duration_ms": "long", "samples": "long", "sample_rate": "long", "frame_offsets": "array<long>", "tags": "map<string,string>", "vbr_table": "string", "bad_checksums": "long", "skipped_bytes": "long", "feature": "string", "payload": "binary"}
_MEDIA_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())


def _described(data: bytes | None) -> tuple:
    data = data or b""
    a = parse(data)
    return a.milliseconds, a.samples, a.rate, a.offsets, list(a.tags.items()), a.table, a.bad_checksums, a.skipped, feature(a), payload_of(data, a)


def probed(files: DataFrame, media: str = "media", columns: tuple[str, ...] = tuple(MEDIA_COLUMNS)) -> DataFrame:
    """The other columns of `files` with what `parse` finds in `media`; MEDIA_COLUMNS of `files` are replaced.

    Null or broken files have no frames, no duration and an empty payload; no bytes make it
    fail. A duration is exactly `samples` at `sample_rate`, or whole milliseconds rounded
    down. Frames of free format aren't known. Repeated rows are read alike.
    """
    kept = [c for c in files.columns if c not in columns and c != media]
    wanted = [list(MEDIA_COLUMNS).index(c) for c in columns]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_described(x.as_py()) for x in batch.column(media)]
            added = [pa.array([f[i] for f in found], _MEDIA_TYPES[i]) for i in wanted]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added], names=[*kept, *columns])

    schema = ", ".join([f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {MEDIA_COLUMNS[c]}" for c in columns])
    return files.select(*kept, media).mapInArrow(task, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(table(spark, sf_dir, "documents"))
    media = [F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    back = probed(files.select("*", *media), columns=("payload", "feature", "samples", "sample_rate", "frame_offsets"))
    payload = F.col("payload")
    return back.select("doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "frame_offsets")
