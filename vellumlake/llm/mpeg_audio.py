"""MPEG audio as a media column: a carrier for bytes, and the parser of such streams.

write_stream() stores bytes losslessly in MPEG-1 layer III frames: an ID3v2 tag (payload
length and CRC-32), a VBR header frame with its table of contents, then frames whose side
information says "silence" and whose ancillary data hold the payload, 576 bytes a frame.
parse() works on any MPEG 1/2/2.5 layer I-III stream, free format among them: it skips tags,
resynchronises on frame headers (two headers must agree), reads Xing/Info/VBRI tables and
compares their counts with the frames, verifies the CRC-16 of protected frames of all layers
and gives exact durations and seek offsets.

Defined results: null and empty texts give one unit of padding; a stream without frames has
duration 0 and no offsets; bytes between frames are counted as junk; a cut last frame is
counted apart and takes no part in the duration; equal texts have equal streams, so ties and
repeated rows are alike; columns besides id and text are not read; a text is held whole by the
task that stores it, three times at most.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumlake.llm.common import map_arrow, pieces, text_or_empty

UNIT = 576  # payload bytes of a frame: the samples of a granule
# Fixed values of the format (ISO/IEC 11172-3, 13818-3): kbit/s by version 1 or 2, layer, index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Layer II (ISO/IEC 11172-3 tables B.2, 13818-3 B.1): bits of an allocation and for how many subbands.
ALLOCATION = {"wide": ((4, 11), (3, 12), (2, 7)), "narrow": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # bits: 3 is MPEG 1, 2 is MPEG 2, 0 is MPEG 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int  # bytes of side information (layer III)
    bound: int = 32  # first subband that the channels share (layers I and II)
    free: bool = False  # no bitrate given: the distance of headers is the length


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """What four bytes say; None if they are no frame header. In free format bitrate and length are 0."""
    if len(raw) < 4 or raw[0] != 255 or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate == 3 or index == 15 or raw[3] & 3 == 2:
        return None
    kbps, hz, pad = BITRATES[1 if version == 3 else 2, layer][index], RATES[version][rate], raw[2] >> 1 & 1
    mono = raw[3] >> 6 == 3
    bound = 4 + 4 * (raw[3] >> 4 & 3) if raw[3] >> 6 == 1 else 32
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Header(version, layer, not raw[1] & 1, kbps, hz, mono, length if index else 0, samples, side if layer == 3 else 0, bound, not index)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=65_536)
def crc16(data: bytes) -> int:
    """The checksum of a protected frame: polynomial 8005, from FFFF, most significant bit first."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 8 ^ b]) & 0xFFFF
    return c


def _crc16_bits(data: bytes, bits: int) -> int:
    c = crc16(bytes(data[: bits // 8]))
    for k in range(bits % 8):
        bit = data[bits // 8] >> (7 - k) & 1
        c = (c << 1 ^ 0x8005) & 0xFFFF if (c >> 15) ^ bit else c << 1 & 0xFFFF
    return c


def _checked_bits(frame: bytes, h: Header) -> int:
    """How many bits after the checksum it covers: the side information of layer III, the bit allocation of layer I, and
    the allocation with the scale factors' selection of layer II."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (32 if h.mono else min(h.bound, 32) + 32)
    kbps = h.kbps // channels
    if h.version != 3:
        widths, bands = ALLOCATION["low"], 30
    elif h.kbps and kbps < 56:
        widths, bands = ALLOCATION["narrow"], 12 if h.rate == 32000 else 8
    else:
        widths, bands = ALLOCATION["wide"], 30 if h.rate != 48000 and (kbps >= 96 or not h.kbps) else 27
    value, at, used = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6), 0
    start = at
    for band, width in enumerate([w for w, n in widths for _ in range(n)][:bands]):
        for _ in range(channels if band < h.bound else 1):
            at -= width
            if at < 0:
                return start
            used += bool(value >> at & ((1 << width) - 1)) * (1 if band < h.bound else channels)
    return min(start, start - at + 2 * used)


def _free_length(raw: bytes, i: int, h: Header) -> int:
    """Length without padding of a free-format frame: the distance to the next header of its kind, if the one after
    that is as far or the stream ends there; 0 if there is none."""
    slot = 4 if h.layer == 1 else 1
    pad = lambda k: slot * (raw[k + 2] >> 1 & 1)
    j = raw.find(bytes((255, raw[i + 1])), i + 4 + h.side)
    while 0 <= j < i + 8192:
        other = header(raw[j : j + 4])
        if other and other.free and other.rate == h.rate:
            size = j - i - pad(i)
            k = j + size + pad(j)
            third = header(raw[k : k + 4])
            if k == len(raw) or third and third.free and third.rate == h.rate:
                return size
        j = raw.find(bytes((255, raw[i + 1])), j + 1)
    return 0


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _txxx(name: str, value: str) -> bytes:
    body = b"\x00" + name.encode("latin-1") + b"\x00" + value.encode("latin-1")
    return b"TXXX" + _synchsafe(len(body)) + b"\x00\x00" + body


def write_stream(payload: bytes, unit: int = UNIT) -> bytes:
    """payload in mono 48 kHz frames; the smallest bitrate that holds a frame's share is taken."""
    frames = [payload[i : i + unit] for i in range(0, len(payload), unit)]
    ladder = [(i, 3 * k) for i, k in enumerate(BITRATES[1, 3]) if i]  # bytes at 48 kHz: 3 x kbit/s
    rung = lambda n: next((x for x in ladder if x[1] >= n), None)
    head = 4 + 2 + 17
    if unit < 1 or rung(unit + head) is None:
        raise ValueError("unit doesn't fit a frame")
    index, size = rung(unit + head)
    start = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    full = start + crc16(start[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)
    n = len(payload) // unit
    body = np.zeros((n, size), np.uint8)
    body[:, :head] = np.frombuffer(full, np.uint8)
    body[:, head : head + unit] = np.frombuffer(payload, np.uint8, n * unit).reshape(n, unit)
    audio = body.tobytes()
    if rest := payload[n * unit :]:
        index, small = rung(len(rest) + head)
        start = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
        audio += (start + crc16(start[2:] + bytes(17)).to_bytes(2, "big") + bytes(17) + rest).ljust(small, b"\x00")
    first = 192  # 64 kbit/s hold the table of contents
    total = first + len(audio)
    toc = bytes(min(255, (first + size * (len(frames) * i // 100)) * 256 // total) for i in range(100))
    info = bytes((0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0)) + bytes(17) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    tags = _txxx("PAYLOAD_BYTES", str(len(payload))) + _txxx("PAYLOAD_CRC32", str(zlib.crc32(payload)))
    return b"ID3\x04\x00\x00" + _synchsafe(len(tags)) + tags + info.ljust(first, b"\x00") + audio


@dataclass
class Stream:
    tags: dict = field(default_factory=dict)
    vbr: dict | None = None
    frames: int = 0
    samples: int = 0
    rate: int = 0
    version: int = 0
    layer: int = 0
    channels: int = 0
    kbps: dict = field(default_factory=dict)  # bitrate -> frames
    checked: int = 0
    bad_crc: int = 0
    junk_bytes: int = 0
    resyncs: int = 0
    cut: int = 0
    audio_bytes: int = 0  # of the frames, the table's among them
    offsets: list = field(default_factory=list)  # byte offset of every seek_every-th frame
    ancillary: list = field(default_factory=list)

    @property
    def duration(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    @property
    def table_ok(self) -> bool | None:
        """Whether the table's counts are those of the stream; None without a table."""
        if self.vbr is None:
            return None
        return self.vbr.get("frames", self.frames) == self.frames and self.vbr.get("bytes", self.audio_bytes) == self.audio_bytes


def _id3(raw: bytes, at: int, tags: dict) -> int:
    size = 0
    for b in raw[at + 6 : at + 10]:
        size = size << 7 | b & 127
    version, i, end = raw[at + 3], at + 10, min(len(raw), at + 10 + size)
    while i + 10 <= end and raw[i : i + 4].strip(b"\x00"):
        n = 0
        for b in raw[i + 4 : i + 8]:
            n = n << 7 | b & 127 if version == 4 else n << 8 | b
        body = raw[i + 10 : i + 10 + n]
        if raw[i : i + 1] == b"T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            words = body[1:].decode(code, "replace").split("\x00")
            tags[words[0] if raw[i : i + 4] == b"TXXX" and len(words) > 1 else raw[i : i + 4].decode("latin-1")] = words[1] if raw[i : i + 4] == b"TXXX" and len(words) > 1 else words[0]
        i += 10 + n
    return at + 10 + size + (10 if raw[at + 5] & 16 else 0)


def _vbr(frame: bytes, h: Header) -> dict | None:
    at = 4 + 2 * h.protected + h.side
    name = frame[at : at + 4]
    if name in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": name.decode()}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = int.from_bytes(frame[at : at + 4], "big")
                at += 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n, k = int.from_bytes(frame[54:56], "big"), int.from_bytes(frame[58:60], "big")
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "toc": [int.from_bytes(frame[62 + k * i : 62 + k * (i + 1)], "big") for i in range(n)]}
    return None


def _begins_inside(raw: bytes, start: int, end: int, h: Header) -> bool:
    """Whether two agreeing frames begin within what claims to be one: then it is junk."""
    j = raw.find(b"\xff", start + 1, end)
    while j >= 0:
        a = header(raw[j : j + 4])
        b = a and not a.free and header(raw[j + a.length : j + a.length + 4])
        if b and {(x.version, x.layer, x.rate) for x in (a, b)} == {(h.version, h.layer, h.rate)}:
            return True
        j = raw.find(b"\xff", j + 1, end)
    return False


def parse(raw: bytes, seek_every: int = 64, ancillary: bool = False) -> Stream:
    """Everything that the frames say. Frames agree on version, layer and sample rate."""
    s, i, n, mark, synced, free = Stream(), 0, len(raw), None, False, 0
    while i < n:
        h = header(raw[i : i + 4])
        if h is not None and h.free:
            free = free or _free_length(raw, i, h)
            h = replace(h, length=free + (4 if h.layer == 1 else 1) * (raw[i + 2] >> 1 & 1)) if free else None
        if h is not None and (mark is None or mark == (h.version, h.layer, h.rate)):
            end = i + h.length
            if end > n:
                s.cut += 1
                break
            nxt = header(raw[end : end + 4])
            agrees = nxt is not None and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate)
            if agrees or end == n or raw[end : end + 3] == b"TAG" or synced and not _begins_inside(raw, i, end, h):
                synced, mark = agrees, (h.version, h.layer, h.rate)
                if h.protected and h.length >= 6:
                    bits = _checked_bits(raw[i:end], h) if h.layer < 3 else 8 * h.side
                    s.checked += 1
                    s.bad_crc += _crc16_bits(raw[i + 2 : i + 4] + raw[i + 6 : i + 6 + -(-bits // 8)], 16 + bits) != raw[i + 4] << 8 | raw[i + 5]
                s.audio_bytes += h.length
                table = _vbr(raw[i:end], h) if s.frames == 0 and s.vbr is None and h.layer == 3 else None
                if table:
                    s.vbr = table
                else:
                    if s.frames % seek_every == 0:
                        s.offsets.append(i)
                    s.frames += 1
                    s.samples += h.samples
                    s.kbps[h.kbps] = s.kbps.get(h.kbps, 0) + 1
                    if ancillary:
                        s.ancillary.append(raw[i + 4 + 2 * h.protected + h.side : end])
                s.version, s.layer, s.rate, s.channels = h.version, h.layer, h.rate, 1 if h.mono else 2
                i = end
                continue
        if raw[i : i + 3] == b"ID3" and i + 10 <= n and max(raw[i + 6 : i + 10]) < 128:
            i = _id3(raw, i, s.tags)
            continue
        if raw[i : i + 3] == b"TAG" and n - i == 128:
            s.tags.setdefault("TITLE1", raw[i + 3 : i + 33].rstrip(b"\x00 ").decode("latin-1"))
            break
        if s.frames and not s.junk_bytes or synced:
            s.resyncs += 1
        synced = False
        j = raw.find(b"\xff", i + 1)
        k = raw.find(b"ID3", i + 1, n if j < 0 else j)
        j = min((x for x in (j, k) if x >= 0), default=n)
        s.junk_bytes += j - i
        i = j
    return s


def read_payload(raw: bytes, unit: int = UNIT, seek_every: int = 64) -> tuple[bytes, Stream]:
    """The bytes that write_stream() stored; ValueError if a checksum, a count or a length is wrong."""
    s = parse(raw, seek_every, ancillary=True)
    size = int(s.tags["PAYLOAD_BYTES"])
    whole, last = divmod(size, unit)
    out = b"".join([x[:unit] for x in s.ancillary[:whole]] + [x[:last] for x in s.ancillary[whole : whole + 1]])
    if len(out) != size or zlib.crc32(out) != int(s.tags["PAYLOAD_CRC32"]) or s.bad_crc or s.cut or not s.table_ok:
        raise ValueError("damaged stream")
    return out, s


def padded(text: str, unit: int = UNIT) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * ((-len(raw)) % unit or (unit if not raw else 0))


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_media: bool = False, seek_every: int = 64) -> DataFrame:
    """Each text stored as an MPEG audio stream, read back and described; no shuffle.

    feature: sample rate, frames, duration in samples, bitrates, the table and whether it agrees with the stream,
    checked and bad checksums. duration_s is n_samples / sample_rate; seek_offsets has the byte offset of every
    seek_every-th frame. keep_media adds the stream."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_s double, n_samples bigint, sample_rate int, n_frames bigint, seek_offsets array<bigint>" + ", media binary" * keep_media

    def run(whole: pa.RecordBatch):
        for batch in pieces(whole):
            rows = []
            for text in batch.column(1).to_pylist():
                n, payload = padded(text)
                media = write_stream(payload)
                back, s = read_payload(media, seek_every=seek_every)
                feature = f"mpeg1-layer3;rate={s.rate};channels={s.channels};frames={s.frames};samples={s.samples};kbps={'/'.join(f'{k}x{v}' for k, v in sorted(s.kbps.items()))};toc={s.vbr['kind']}:{s.vbr['frames']}:{'ok' if s.table_ok else 'bad'};crc={s.checked}/{s.bad_crc}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.duration, s.samples, s.rate, s.frames, s.offsets) + ((media,) if keep_media else ()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * keep_media
            names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "n_samples", "sample_rate", "n_frames", "seek_offsets"] + ["media"] * keep_media
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return map_arrow(df.select(F.col(id_col), text_or_empty(text_col).alias("_text")), run, schema)
