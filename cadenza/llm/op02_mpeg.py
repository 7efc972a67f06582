"""Text bytes in MPEG audio (operator 2): write, resynchronise, verify, index.

A stream is an ID3v2.4 tag, a frame with the variable-bitrate table, and MPEG-1 Layer III mono frames
of 48 kHz whose main data is the payload. Every audio frame carries a checksum. All frames but the last
are of 320 kbit/s (960 bytes, 937 of payload); the last is of the smallest bitrate that holds the rest,
which makes the bitrate variable. A frame's payload size is what its side information says its two
granules hold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Scratch

UNIT = 192
RATE = 48_000
SAMPLES = 1152
SIDE = 17
HEAD = 4 + 2 + SIDE
#: kbit/s of MPEG-1 Layer III by bitrate index, and sample rates by their index.
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES = (44_100, 48_000, 32_000)
ROOM = KBITS[14] * 3 - HEAD
#: A seek offset is stored for every so many frames (42 frames of 24 ms: about a second).
SEEK_EVERY = 42


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        x <<= 8
        for _ in range(8):
            x = (x << 1) ^ 0x8005 if x & 0x8000 else x << 1
        out.append(x & 0xFFFF)
    return out


_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, start 0xFFFF, highest bit first."""
    value = 0xFFFF
    for b in data:
        value = ((value << 8) & 0xFFFF) ^ _TABLE[(value >> 8) ^ b]
    return value


def syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def from_syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3(fields: dict[str, str]) -> bytes:
    frames = b""
    for name, value in fields.items():
        body = b"\x03" + name.encode() + b"\x00" + value.encode()
        frames += b"TXXX" + syncsafe(len(body)) + b"\x00\x00" + body
    return b"ID3\x04\x00\x00" + syncsafe(len(frames)) + frames


def _head(index: int, protected: bool) -> bytes:
    """Header of an MPEG-1 Layer III mono frame of 48 kHz."""
    return bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | 1 << 2, 0xC4])


def _side(held: int) -> bytes:
    """Side information: both granules' part2_3_length say how many bits of main data they hold; all else is zero."""
    first = min(held, 511)
    bits = 0
    bits |= (first * 8) << (SIDE * 8 - 18 - 12)  # after main_data_begin (9), private bits (5) and scfsi (4)
    bits |= ((held - first) * 8) << (SIDE * 8 - 18 - 59 - 12)  # a mono granule has 59 bits
    return bits.to_bytes(SIDE, "big")


def _held(side: bytes) -> int:
    bits = int.from_bytes(side, "big")
    return ((bits >> (SIDE * 8 - 30)) & 0xFFF) // 8 + ((bits >> (SIDE * 8 - 89)) & 0xFFF) // 8


def _start(index: int, held: int) -> bytes:
    head, side = _head(index, True), _side(held)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_FULL = _start(14, ROOM)


def pad(data: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of the unit."""
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def write(payload: bytes, n_bytes: int) -> bytes:
    """The stream of a payload. n_bytes: of the text, without what pads it."""
    full, rest = divmod(len(payload), ROOM)
    frames = [_FULL + payload[i * ROOM : (i + 1) * ROOM] for i in range(full)]
    if rest:
        index = next(i for i in range(1, 15) if KBITS[i] * 3 >= HEAD + rest)
        frames.append((_start(index, rest) + payload[full * ROOM :]).ljust(KBITS[index] * 3, b"\0"))
    audio = b"".join(frames)
    size = KBITS[5] * 3  # 192 bytes: room for the table's 120 after 21 of header and side information
    total = size + len(audio)
    toc = bytes(min(255, (size + min(len(audio), (len(frames) * i // 100) * KBITS[14] * 3)) * 256 // total) for i in range(100))
    table = b"Xing" + struct.pack(">3I", 7, len(frames), total) + toc
    return _id3({"n_bytes": str(n_bytes), "payload_bytes": str(len(payload))}) + (_head(5, False) + bytes(SIDE) + table).ljust(size, b"\0") + audio


class Frame(NamedTuple):
    at: int
    size: int
    samples: int
    rate: int
    body: int
    held: int
    sound: bool  # its checksum holds, or it has none


class Stream(NamedTuple):
    tags: dict[str, str]
    vbr: tuple[int, int, bytes] | None  # frames, bytes and table of contents that the stream states
    frames: list[Frame]
    skipped: int  # bytes passed over to find a frame again

    @property
    def seconds(self) -> float:
        return sum(f.samples / f.rate for f in self.frames)


def _size(data: bytes, at: int) -> tuple[int, int] | None:
    """Size and rate of a MPEG-1 Layer III frame that begins here, if one does."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    index, kind = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if index in (0, 15) or kind == 3:
        return None
    return SAMPLES // 8 * KBITS[index] * 1000 // RATES[kind] + (data[at + 2] >> 1 & 1), RATES[kind]


def _protected(data: bytes, at: int) -> tuple[bytes, int] | None:
    """What a frame's checksum covers, and the checksum; None for a frame without one."""
    if data[at + 1] & 1:
        return None
    side = SIDE if data[at + 3] >> 6 == 3 else 32
    return data[at + 2 : at + 4] + data[at + 6 : at + 6 + side], data[at + 4] << 8 | data[at + 5]


def _closing(data: bytes, at: int, end: int) -> bool:
    """Whether the 128 bytes of an ID3v1 tag are all that is left here."""
    return end - at == 128 and data[at : at + 3] == b"TAG"


def _frame(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Size and rate of a frame that begins here: one that fits, and that another, a closing tag or the end follows, or whose checksum holds."""
    found = _size(data, at)
    if not found or at + found[0] > end:
        return None
    if at + found[0] == end or _closing(data, at + found[0], end) or _size(data, at + found[0]):
        return found
    covered = _protected(data, at)
    return found if covered and crc16(covered[0]) == covered[1] else None


def _sync(data: bytes, at: int, end: int) -> int:
    """Where the next frame begins, or the end."""
    tag = end - 128 if end - 128 >= at and _closing(data, end - 128, end) else end
    while (at := data.find(b"\xff", at, tag)) >= 0:
        if _frame(data, at, end):
            return at
        at += 1
    return tag


def parse(data: bytes) -> Stream:
    """Tags, table and frames of a stream; what is not a frame is passed over up to the next one.

    Frames come before tags: "TAG" 128 bytes before the end begins a tag only where no frame covers that place, so it may stand in main data.
    """
    at, end, tags, vbr, frames, skipped = 0, len(data), {}, None, [], 0
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        stop, i = min(end, at + 10 + from_syncsafe(data[at + 6 : at + 10])), at + 10
        while i + 10 <= stop and data[i : i + 4].strip(b"\0"):
            n = from_syncsafe(data[i + 4 : i + 8])
            name, _, value = data[i + 11 : i + 10 + n].decode("utf-8", "replace").partition("\0")
            if data[i : i + 4] == b"TXXX":
                tags[name] = value
            else:
                tags[data[i : i + 4].decode("latin-1")] = name
            i += 10 + n
        at = stop
    crcs: dict[bytes, int] = {}
    while at < end:
        if _closing(data, at, end):
            for name, i, n in (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4)):
                if value := data[at + i : at + i + n].split(b"\0")[0].decode("latin-1").strip():
                    tags.setdefault(name, value)
            break
        found = _frame(data, at, end)
        if not found:
            begins = _sync(data, at + 1, end)
            skipped += begins - at
            at = begins
            continue
        size, rate = found
        protected = not data[at + 1] & 1
        side = SIDE if data[at + 3] >> 6 == 3 else 32
        body = at + 4 + 2 * protected + side
        table = data[at + 4 + side : at + 8 + side]
        if not frames and vbr is None and table in (b"Xing", b"Info"):
            flags, i, n_frames, n_bytes, toc = struct.unpack_from(">I", data, at + 8 + side)[0], at + 12 + side, 0, 0, b""
            if flags & 1:
                n_frames, i = struct.unpack_from(">I", data, i)[0], i + 4
            if flags & 2:
                n_bytes, i = struct.unpack_from(">I", data, i)[0], i + 4
            if flags & 4:
                toc = data[i : i + 100]
            vbr = (n_frames, n_bytes, toc)
        else:
            sound = True
            if protected:
                covered, stated = _protected(data, at)
                if covered not in crcs:
                    crcs[covered] = crc16(covered)
                sound = crcs[covered] == stated
            held = min(_held(data[body - SIDE : body]), at + size - body) if side == SIDE else 0
            frames.append(Frame(at, size, SAMPLES, rate, body, held, sound))
        at += size
    return Stream(tags, vbr, frames, skipped)


def payload_of(data: bytes, stream: Stream) -> bytes:
    return b"".join(data[f.body : f.body + f.held] for f in stream.frames)


def feature(stream: Stream) -> str:
    """Exact duration (samples and rate), frames, checksums, the stated table against what was found, skipped bytes, digest of all frame offsets."""
    offsets = struct.pack(f"<{len(stream.frames)}Q", *[f.at for f in stream.frames])
    stated = bool(stream.vbr) and stream.vbr[0] == len(stream.frames)
    samples = sum(f.samples for f in stream.frames)
    return f"samples={samples};rate={stream.frames[0].rate if stream.frames else 0};frames={len(stream.frames)};bad_crc={sum(not f.sound for f in stream.frames)};table={'agrees' if stated else 'differs'};skipped={stream.skipped};offsets={zlib.crc32(offsets):08x}"


def store(df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each whole text as a stream: doc_id, media, in a Parquet table in the shared folder.

    Null and empty texts are one unit of blanks. A text may be as long as a row: a task holds one stream and its payload. Repeated rows and null
    doc_ids stay, an empty table gives an empty one, and other columns, whatever their names, are not read.
    """
    key = df.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                raw = [(x.as_py() or "").encode() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write(pad(r), len(r)) for r in raw], pa.binary())], names=[doc_id, "media"])

    return scratch.keep(df.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {key}, media binary"), "media")


def read(media: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Parse stored streams: sizes and digests of payload and stream, features, duration and seek offsets.

    ``seek_offsets`` holds the byte offset of every 42nd frame (about one a second), ``seconds`` the exact
    duration. A frame whose checksum fails, or a payload shorter than the tag says, is an error: this store
    is lossless.
    """
    key = media.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [doc_id, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "seek_offsets"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
        for b in batches:
            rows = []
            for x in b.column(1):
                data = x.as_py()
                stream = parse(data)
                payload = payload_of(data, stream)
                if len(payload) != int(stream.tags["payload_bytes"]) or not all(f.sound for f in stream.frames):
                    raise ValueError("a stored stream is damaged")
                rows.append((int(stream.tags["n_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream), stream.seconds, [f.at for f in stream.frames[::SEEK_EVERY]]))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    return media.select(doc_id, "media").mapInArrow(run, f"`{doc_id}` {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, seek_offsets array<long>")
