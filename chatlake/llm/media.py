"""MPEG audio columns: frames of Layer III that carry a payload, and a reader that resynchronises, checks and indexes them.

``encoded`` stores bytes as a variable-bitrate stream: an ID3v2 tag with the payload's length, an information frame with the
frame count, the byte count and a table of 100 seek points, then mono frames with a CRC, each of the smallest bitrate whose main data holds
what is left. ``parsed`` reads any stream: it skips tags, looks for a header whose frame length leads to another header (or the end),
verifies the CRC of protected frames of all layers, reads the table of variable-bitrate streams (Xing, Info or VBRI), and gives exact
durations in samples and the offset of every frame.

Null text counts as empty; its payload is 64 zero bytes. Equal texts give equal values; repeated rows are worked on one by one. An
empty table gives no rows. A stream without frames has no duration; bytes between frames are counted as lost, not guessed at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chatlake.llm.common import read, steps
from chatlake.llm.registry import query

# Fixed values of the MPEG audio format: kbit/s by (MPEG-1?, layer) and header index, Hz by version and index.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_START, CRC_POLYNOMIAL = 0xFFFF, 0x8005
#: Layer II: bits of each subband's allocation, by table: (bits, subbands) in order.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)),
              "low": ((4, 4), (3, 7), (2, 19))}

#: What ``encoded`` writes: MPEG-1 Layer III, mono, 44.1 kHz, protected.
_SIDE = 17
_HEAD = 4 + 2 + _SIDE
UNIT = 64


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ CRC_POLYNOMIAL if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


_CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of all bytes, or of the first ``bits`` bits."""
    whole, rest = divmod(8 * len(data) if bits is None else bits, 8)
    value = CRC_START
    for byte in data[:whole]:
        value = (value << 8 & 0xFFFF) ^ _CRC[value >> 8 ^ byte]
    for k in range(rest):
        bit = data[whole] >> 7 - k & 1 ^ value >> 15
        value = (value << 1 & 0xFFFF) ^ CRC_POLYNOMIAL * bit
    return value


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbits: int
    hertz: int
    mono: bool
    length: int
    samples: int
    #: First subband that joint stereo stores once for both channels; 32 without joint stereo.
    bound: int = 32

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def allocation(h: Header) -> list[int]:
    """Layer II: bits of the allocation of each subband."""
    each = h.kbits if h.mono else h.kbits // 2
    if h.version != 3:
        table = "low"
    elif 56 <= each and (h.hertz == 48000 or each <= 80):
        table = "a"
    elif each >= 96:
        table = "b"
    else:
        table = "d" if h.hertz == 32000 else "c"
    return [bits for bits, n in ALLOCATION[table] for _ in range(n)]


def guarded(h: Header, body: bytes) -> int | None:
    """Bits behind the checksum that it covers: side information of Layer III, allocation of I, allocation and scale factor selection
    of II. None if they do not fit the frame."""
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        bits = 4 * (32 if h.mono else 32 + h.bound)
    else:
        stream, bits, chosen = int.from_bytes(body, "big"), 0, 0
        for band, width in enumerate(allocation(h)):
            shared = band >= h.bound
            for _ in range(1 if h.mono or shared else 2):
                value = stream >> max(0, 8 * len(body) - bits - width) & (1 << width) - 1
                bits += width
                chosen += 0 if not value else 2 if shared and not h.mono else 1
        bits += 2 * chosen
    return bits if bits <= 8 * len(body) else None


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The header in four bytes; None if they are none, or one of free format, whose length is not known."""
    if four not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[four] = _header(four)
    return _HEADERS[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, speed = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or speed == 3 or four[3] & 3 == 2:
        return None
    kbits, hertz, pad = KBITS[version == 3, layer][rate], HERTZ[version][speed], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12 * kbits * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + pad
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbits, hertz, four[3] >> 6 == 3, length, samples, bound)


@dataclass
class Stream:
    tags: list[str] = field(default_factory=list)
    payload_bytes: int | None = None
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    #: Xing and Info: 100 places in 256ths of the bytes.
    table_seek: bytes = b""
    #: VBRI: bytes of each step, and frames in one.
    table_steps: list[int] = field(default_factory=list)
    table_step_frames: int | None = None
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    checked: int = 0
    bad_checks: int = 0
    lost: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def hertz(self) -> int:
        return self.headers[0].hertz if self.headers else 0

    def seek(self, sample: int) -> int | None:
        """Offset of the frame that holds a sample; None beyond the end."""
        for at, h in zip(self.offsets, self.headers, strict=True):
            if sample < h.samples:
                return at
            sample -= h.samples
        return None


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _frame(index: int, body: bytes, room: int) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4, 0xC0))
    side = bytes(_SIDE)
    return b"".join((head, _SIDE_CRC[index], side, body, bytes(room - len(body))))


def _lengths() -> list[int]:
    return [144 * k * 1000 // 44100 for k in KBITS[True, 3]]


_LENGTH = _lengths()
_SIDE_CRC = [crc16(bytes((i << 4, 0xC0)) + bytes(_SIDE)).to_bytes(2, "big") for i in range(15)]
#: Bitrate index of all frames but the last, and the smallest index by main data.
_FULL = 9


def _index_for(n: int) -> int:
    return next(i for i in range(1, _FULL + 1) if _LENGTH[i] - _HEAD >= n)


def encoded(payload: bytes) -> bytes:
    """The stored form of a payload."""
    note = b"TXXX" + _synchsafe(1 + 8 + 12) + b"\0\0" + b"\0payload\0"[:9] + b"%012d" % len(payload)
    tag = b"ID3\x04\0\0" + _synchsafe(len(note)) + note
    room = _LENGTH[_FULL] - _HEAD
    frames = []
    for at in range(0, len(payload), room):
        body = payload[at:at + room]
        index = _FULL if len(body) == room else _index_for(len(body))
        frames.append(_frame(index, body, _LENGTH[index] - _HEAD))
    info_length = _LENGTH[_index_for(120)]
    total = info_length + sum(map(len, frames))
    ends, seek = [info_length], bytearray()
    for f in frames:
        ends.append(ends[-1] + len(f))
    for percent in range(100):
        seek.append(min(255, ends[min(len(ends) - 1, percent * len(frames) // 100)] * 256 // total))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(seek)
    index = _index_for(120)
    return b"".join((tag, _frame(index, table, _LENGTH[index] - _HEAD), *frames))


def _leads_on(data: bytes, at: int, h: Header, closing: int | None) -> bool:
    """Whether the frame at ``at`` is followed by a frame, the closing tag or the end."""
    after = at + h.length
    return after in (len(data), closing) or (after < len(data) and header(data[after:after + 4]) is not None)


def parsed(data: bytes) -> Stream:
    """Tags, the table of variable-bitrate streams, and all whole frames of a stream."""
    out, at = Stream(), 0
    while data[at:at + 3] == b"ID3" and len(data) >= at + 10:
        size = 0
        for byte in data[at + 6:at + 10]:
            size = size << 7 | byte & 0x7F
        body = data[at + 10:at + 10 + size]
        out.tags.append("ID3v2.%d" % data[at + 3])
        if b"payload\0" in body:
            number = body.partition(b"payload\0")[2][:12]
            out.payload_bytes = int(number) if number.isdigit() else None
        at += 10 + size + (10 if data[at + 5] & 0x10 else 0)
    # The place of a closing tag. Payload can have the same letters there: it is a tag only if no whole frame reaches past it.
    end, reached = len(data), at
    closing = end - 128 if end - at >= 128 and data[end - 128:end - 125] == b"TAG" else None
    synchronised = False
    while at + 4 <= end and not (synchronised and at == closing):
        h = header(data[at:at + 4])
        sure = synchronised and not (closing is not None and h is not None and at < closing < at + h.length)
        if h is None or at + h.length > end or not (sure or _leads_on(data, at, h, closing)):
            nearest = data.find(b"\xff", at + 1, end)
            nearest = end if nearest < 0 else nearest
            out.lost += nearest - at
            at, synchronised = nearest, False
            continue
        synchronised = True
        start = at + 4 + 2 * h.protected
        if h.protected:
            out.checked += 1
            body = data[start:start + h.side] if h.layer == 3 else data[start:min(start + 64, at + h.length)]
            bits = guarded(h, body)
            out.bad_checks += bits is None or crc16(data[at + 2:at + 4] + body, 16 + bits).to_bytes(2, "big") != data[at + 4:at + 6]
        info = start + h.side
        first = not out.headers and out.table is None and h.layer == 3
        if first and data[info:info + 4] in (b"Xing", b"Info"):
            out.table = data[info:info + 4].decode()
            flags, place = int.from_bytes(data[info + 4:info + 8], "big"), info + 8
            if flags & 1:
                out.table_frames = int.from_bytes(data[place:place + 4], "big")
            if flags & 2:
                out.table_bytes = int.from_bytes(data[place + 4 * (flags & 1):][:4], "big")
            if flags & 4:
                begin = place + 4 * (flags & 1) + 2 * (flags & 2)
                out.table_seek = data[begin:begin + 100]
        elif first and data[at + 36:at + 40] == b"VBRI" and h.length >= 62:
            out.table = "VBRI"
            out.table_bytes, out.table_frames, n, scale, width, out.table_step_frames = struct.unpack(">IIHHHH", data[at + 46:at + 62])
            places = range(at + 62, min(at + 62 + n * width, at + h.length - width + 1), width or 1)
            out.table_steps = [scale * int.from_bytes(data[x:x + width], "big") for x in places]
        else:
            out.offsets.append(at)
            out.headers.append(h)
        at += h.length
        reached = at
    out.lost += max(0, end - at)
    if closing is not None and reached <= closing:
        out.tags.append("ID3v1")
        out.lost -= 128
    return out


def decoded(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload in a stream that ``encoded`` wrote."""
    stream = stream or parsed(data)
    body = b"".join(data[at + 4 + 2 * h.protected + h.side:at + h.length] for at, h in zip(stream.offsets, stream.headers, strict=True))
    return body[:stream.payload_bytes]


def padded(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the text's bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def feature(stream: Stream) -> str:
    """Version and layer, frames, exact samples at Hz, mean bit/s, checks, first and last frame offset, and a digest of all offsets."""
    if not stream.headers:
        return "no frames"
    h, samples = stream.headers[0], stream.samples
    size = sum(x.length for x in stream.headers)
    offsets = zlib.crc32(struct.pack(f"<{len(stream.offsets)}q", *stream.offsets))
    return (f"v{h.version}l{h.layer} frames={len(stream.headers)} samples={samples}@{h.hertz} bps={size * 8 * h.hertz // samples} "
            f"crc={stream.checked - stream.bad_checks}/{stream.checked} table={stream.table_frames} lost={stream.lost} "
            f"seek={stream.offsets[0]}..{stream.offsets[-1]} index={offsets:08x}")


SCHEMA = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
          "media_sha256 string, feature string, duration_samples long, sample_rate int, n_frames int, bad_checks int, "
          "frame_offsets array<long>, table_kind string, table_frames long, table_bytes long, table_seek array<int>, "
          "table_steps array<long>, table_step_frames int")


def media_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``media`` (the stored bytes) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            stored = [encoded(padded(x)[1]) for x in step["text"].to_pylist()]
            sizes = [len((x or "").encode()) for x in step["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([step["doc_id"], pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame) -> DataFrame:
    """Columns read back from stored streams (``doc_id``, ``n_bytes``, ``media``)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "media"):
            rows = []
            for doc_id, size, data in zip(*(step[c].to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                stream = parsed(data)
                payload = decoded(data, stream)
                rows.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data),
                             hashlib.sha256(data).hexdigest(), feature(stream), stream.samples, stream.hertz, len(stream.headers),
                             stream.bad_checks, stream.offsets, stream.table, stream.table_frames, stream.table_bytes,
                             list(stream.table_seek), stream.table_steps, stream.table_step_frames))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                     pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64(),
                     pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32()]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return media.mapInArrow(run, SCHEMA)


@query()
def op6_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return described(media_rows(read(spark, folder, "documents")))
