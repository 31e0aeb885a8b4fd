"""MPEG audio in a column: write payloads as Layer III streams, and read any Layer I-III stream.

Reading finds frame headers again after foreign bytes, parses ID3 tags and the tables of variable-bitrate
streams (Xing, Info, VBRI), verifies frames' checksums and gives the exact duration as samples over sample rate
and the byte offset of every frame. Frames of free bitrate, whose length no header tells, count as foreign bytes.
Writing stores a payload in the ancillary bytes of silent,
checksummed frames behind an ID3 tag and an Info frame, so that any player can walk the stream and the
bytes come back unchanged.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame

from colloquy.llm.common import map_rows, texts_of, typed

#: Fixed values of the format. kbit/s by (version 1 or not, layer), index 1 to 14.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Hz of version 1; half in version 2, a quarter in 2.5.
RATES = (44100, 48000, 32000)
#: Bytes of Layer III side information by (version 1 or not, mono).
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}

#: Bits of the allocation of each subband in Layer II, by table; the last is that of versions 2 and 2.5.
ALLOCATION = {
    "27 subbands": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "30 subbands": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "8 subbands": (4,) * 2 + (3,) * 6,
    "12 subbands": (4,) * 2 + (3,) * 10,
    "low rates": (4,) * 4 + (3,) * 7 + (2,) * 19,
}

#: The payload is padded to a multiple of this, one block a frame.
BLOCK = 192
#: Version 1, Layer III, 80 kbit/s, 48 kHz, mono: frames of 240 bytes; with and without a checksum.
HEADER, PLAIN_HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0)), bytes((0xFF, 0xFB, 0x64, 0xC0))


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        return SIDE[self.version == 1, self.mono] if self.layer == 3 else 0

    def alike(self, other: Header) -> bool:
        """Frames of one stream may change bitrate, not these."""
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@functools.lru_cache(4096)
def header(word: bytes) -> Header | None:
    """Four bytes read as a frame header; None where they are none, and for free bitrates."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(word[1] >> 3 & 3)
    layer, index, rate = 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbps = BITRATES[version == 1, layer][index - 1]
    hz = RATES[rate] // {1.0: 1, 2.0: 2, 2.5: 4}[version]
    padding = word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    length = (12000 * kbps // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + padding
    return Header(version, layer, not word[1] & 1, kbps, hz, word[3] >> 6 == 3, length, samples)


@functools.lru_cache(1 << 14)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of a frame, of all or the first bits: polynomial 0x8005, most significant bit first, from 0xFFFF."""
    value = 0xFFFF
    for i in range(8 * len(data) if bits is None else min(bits, 8 * len(data))):
        top = (value >> 15) ^ (data[i >> 3] >> (7 - (i & 7)) & 1)
        value = (value << 1 ^ 0x8005 if top else value << 1) & 0xFFFF
    return value


def protected_bits(frame: bytes, shape: Header) -> int:
    """How many bits the checksum of a frame covers, of the header's last 16 and what follows the checksum.

    Layer III: the side information. Layer I: the allocation. Layer II: the allocation and, for each subband of a
    channel that has one, two bits of selection. Above the bound of joint stereo both channels share an allocation.
    """
    if shape.layer == 3:
        return 16 + 8 * shape.side
    channels, joint = 1 if shape.mono else 2, frame[3] >> 6 == 1
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if joint else 32
    if shape.layer == 1:
        return 16 + 4 * sum(channels if sb < bound else 1 for sb in range(32))
    each = shape.kbps / channels
    if shape.version != 1:
        table = ALLOCATION["low rates"]
    elif each <= 48:
        table = ALLOCATION["12 subbands" if shape.rate == 32000 else "8 subbands"]
    else:
        table = ALLOCATION["27 subbands" if each <= 80 or shape.rate == 48000 else "30 subbands"]
    at, chosen = 48, 0
    for sb, size in enumerate(table):
        for _ in range(channels if sb < bound else 1):
            word = int.from_bytes(frame[at >> 3 : (at >> 3) + 2].ljust(2, b"\0"), "big")
            if word >> (16 - (at & 7) - size) & ((1 << size) - 1):
                chosen += 1 if sb < bound else channels
            at += size
    return 16 + at - 48 + 2 * chosen


def synchsafe(value: int) -> bytes:
    return bytes(value >> shift & 0x7F for shift in (21, 14, 7, 0))


def write(payload: bytes) -> bytes:
    """A stream that carries payload, whose length is a positive multiple of BLOCK; the same bytes each time."""
    frames = len(payload) // BLOCK
    side = SIDE[True, True]
    body = b"\x00payload crc32\x00" + b"%08x" % zlib.crc32(payload)
    tag = b"ID3\x04\x00\x00" + synchsafe(len(note := b"TXXX" + synchsafe(len(body)) + b"\0\0" + body)) + note
    shape = header(HEADER)
    total = (frames + 1) * shape.length
    toc = bytes(min(255, 256 * (shape.length * (1 + frames * i // 100)) // total) for i in range(100))
    info = PLAIN_HEADER + bytes(side) + b"Info" + struct.pack(">III", 7, frames, total) + toc
    empty = bytes(side)
    start = HEADER + struct.pack(">H", crc16(HEADER[2:] + empty)) + empty
    fill = bytes(shape.length - len(start) - BLOCK)
    return b"".join([tag, info.ljust(shape.length, b"\0"), *[x for i in range(0, len(payload), BLOCK) for x in (start, payload[i : i + BLOCK], fill)]])


@dataclass
class Stream:
    """What a stream holds. frames: (byte offset, header) without the table frame."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    frames: list[tuple[int, Header]] = field(default_factory=list)
    checked: int = 0
    damaged: list[int] = field(default_factory=list)
    skipped: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for _, h in self.frames)

    @property
    def duration(self) -> Fraction:
        """Exact seconds."""
        return Fraction(self.samples, self.frames[0][1].rate) if self.frames else Fraction(0)

    def seek(self, seconds: float | Fraction) -> int | None:
        """Byte offset of the frame that sounds then; None beyond the end."""
        if not self.frames or seconds < 0 or seconds >= self.duration:
            return None
        first = self.frames[0][1]
        return self.frames[int(Fraction(seconds) * first.rate // first.samples)][0]


def id3(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of a leading ID3v2 tag and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    seven = lambda b: functools.reduce(lambda v, x: v << 7 | x & 0x7F, b, 0)
    end, tags, at = 10 + seven(data[6:10]), {}, 10
    if data[3] in (3, 4):
        if data[5] & 0x40:  # an extended header: its own length is included in version 4 only
            at += seven(data[10:14]) if data[3] == 4 else 4 + int.from_bytes(data[10:14], "big")
        while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
            size = seven(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body = data[at + 10 : at + 10 + size]
            if data[at : at + 1] == b"T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                name, _, value = text.partition("\0")
                key = data[at : at + 4].decode("latin-1")
                tags[f"{key}:{name}" if key == "TXXX" else key] = (value if key == "TXXX" else name).rstrip("\0")
            at += 10 + size
    return end + 10 * bool(data[5] & 0x10), tags


def vbr_table(frame: bytes, shape: Header) -> dict | None:
    """The table frame of Xing, Info or VBRI: frames, bytes and seek points as far as they are given."""
    for at in (4 + shape.side, 4 + 2 + shape.side):
        kind = frame[at : at + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[at : at + 4], "big")
                    at += 4
            if flags & 4:
                out["toc"] = [b * (out.get("bytes") or 0) // 256 for b in frame[at : at + 100]]
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, each = struct.unpack(">IIHHHH", frame[46:62])
        toc, at = [0], 62
        for _ in range(entries):
            toc.append(toc[-1] + scale * int.from_bytes(frame[at : at + width], "big"))
            at += width
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_each": each}
    return None


def read(data: bytes) -> Stream:
    """Walk a stream of any bytes. A frame counts if its length leads to another like it, to a tag or to the end."""
    at, tags = id3(data)
    out, end = Stream(tags), len(data)
    if data[-128:-125] == b"TAG" and len(data) >= at + 128:
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            out.tags.setdefault(name, data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"))
    synced: Header | None = None
    resumes = -1
    while at + 4 <= end:
        shape = header(data[at : at + 4])
        then = at + shape.length if shape else 0
        good = shape is not None and then <= end and (synced is None or shape.alike(synced))
        if good:
            follows = header(data[then : then + 4]) if then + 4 <= end else None
            good = then == end or (follows is not None and follows.alike(shape)) or (synced is not None and (out.frames or out.table is not None) and at == resumes)
        if not good:
            near = data.find(b"\xff", at + 1, end)
            near = end if near < 0 else near
            out.skipped += near - at
            at = near
            continue
        if synced is None and shape.layer == 3 and (table := vbr_table(data[at:then], shape)):
            out.table = table
        else:
            out.frames.append((at, shape))
            if shape.protected:
                out.checked += 1
                bits = protected_bits(data[at:then], shape)
                if crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + (bits - 9) // 8], bits) != int.from_bytes(data[at + 4 : at + 6], "big"):
                    out.damaged.append(at)
        synced, at = shape, then
        resumes = then
    out.skipped += end - at if at < end else 0
    return out


def carried(data: bytes, stream: Stream) -> bytes:
    """The payload of a stream that write() made."""
    start = 6 + SIDE[True, True]
    return b"".join([data[at + start : at + start + BLOCK] for at, _ in stream.frames])


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def feature(stream: Stream) -> str:
    """What a stream is, in words: a function of its bytes."""
    first = stream.frames[0][1] if stream.frames else None
    offsets = ",".join(str(at) for at, _ in stream.frames).encode()
    shape = f"v{first.version:g} layer {first.layer} {first.rate} Hz {'mono' if first.mono else 'stereo'}" if first else "no frames"
    rates = sorted({h.kbps for _, h in stream.frames})
    toc = "" if not stream.table else f" {stream.table['kind']} frames {stream.table.get('frames')}"
    return f"{shape} {'/'.join(map(str, rates))} kbps frames {len(stream.frames)} duration {stream.duration} s checked {stream.checked} damaged {len(stream.damaged)} skipped {stream.skipped}{toc} offsets {hashlib.sha256(offsets).hexdigest()[:16]}"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a stream. Null text is empty; other columns are ignored."""

    def store(columns):
        texts = texts_of(columns["text"])
        return {"doc_id": columns["doc_id"], "n_bytes": [len(t) for t in texts], "media": [write(padded(t)) for t in texts]}

    return map_rows(typed(docs, doc_id="long", text="string"), "doc_id long, n_bytes long, media binary", store)


def probe(media: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds what read() finds in the column media: samples, sample_rate, seek_offsets, damaged and tags.

    Null media and bytes without frames give 0 samples and a null rate. keep: columns to keep.
    """
    kept = media.select(*keep, "media")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep), "samples long, sample_rate int, seek_offsets array<long>, damaged array<long>, tags map<string,string>"])

    def look(columns):
        found = [read(m or b"") for m in columns["media"].to_pylist()]
        return {n: columns[n] for n in keep} | {
            "samples": [s.samples for s in found], "sample_rate": [s.frames[0][1].rate if s.frames else None for s in found],
            "seek_offsets": [[at for at, _ in s.frames] for s in found], "damaged": [s.damaged for s in found], "tags": [list(s.tags.items()) for s in found],
        }

    return map_rows(kept, schema, look)


def media_digests(media: DataFrame) -> DataFrame:
    """Read stored streams of to_media() back: payload digests, the stored form's digest, its feature, exact duration (samples over sample_rate) and where each frame begins.

    Null and empty texts, repeated rows and null doc_ids are rows like any other; an empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int, duration_s double, seek_offsets array<long>"

    def look(columns):
        rows = []
        for doc, n, data in zip(columns["doc_id"].to_pylist(), columns["n_bytes"].to_pylist(), columns["media"].to_pylist()):
            stream = read(data)
            back = carried(data, stream)
            rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream), stream.samples, stream.frames[0][1].rate, float(stream.duration), [at for at, _ in stream.frames]))
        return dict(zip([c.split()[0] for c in schema.split(", ")], zip(*rows)))

    return map_rows(media, schema, look)
