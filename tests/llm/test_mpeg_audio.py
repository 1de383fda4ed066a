import hashlib
import os
import zlib

import pytest

from vellumlake.llm import mpeg_audio as M


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 576 * 300])
def test_round_trip(n):
    payload = os.urandom(n)
    media = M.write_stream(payload)
    back, s = M.read_payload(media)
    assert back == payload and s.bad_crc == 0 and s.junk_bytes == 0
    assert s.frames == s.checked == -(-n // 576) == s.vbr["frames"] and s.duration == s.frames * 1152 / 48000
    assert all(media[o] == 255 and M.header(media[o : o + 4]) for o in s.offsets)


def test_known_header():
    h = M.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (h.version, h.layer, h.kbps, h.rate, h.mono, h.length, h.samples) == (3, 3, 128, 44100, False, 417, 1152)
    h2 = M.header(bytes((0xFF, 0xF3, 0x48, 0xC4)))
    assert (h2.version, h2.layer, h2.kbps, h2.rate, h2.samples) == (2, 3, 32, 16000 if h2.rate == 16000 else h2.rate, 576)
    assert M.header(b"\xff\xfb\xf0\x00") is None and M.header(b"\x00\xfb\x90\x00") is None


def test_crc_of_known_check():
    assert M.crc16(b"123456789") == 0xAEE7  # polynomial 8005, from FFFF, not reflected


def test_resync_and_damage():
    media = M.write_stream(b"x" * 576 * 20)
    first = media.index(b"Xing") - 21 + 192
    cut = first + 672 * 5
    s = M.parse(media[:cut] + b"\xff\xfbgarbage\xff" * 3 + media[cut:])
    assert (s.frames, s.junk_bytes, s.resyncs) == (20, 30, 1)
    hurt = bytearray(media)
    hurt[first + 8] ^= 1  # side information
    assert M.parse(bytes(hurt)).bad_crc == 1
    with pytest.raises(ValueError):
        M.read_payload(bytes(hurt))
    hurt = bytearray(media)
    hurt[-1] ^= 1
    M.read_payload(bytes(hurt))  # a stuffing byte
    assert M.parse(media[:-10]).cut == 1 and M.parse(b"").duration == 0 and M.parse(b"noise" * 50).frames == 0


def test_tags():
    media = M.write_stream(b"abc") + b"TAG" + b"A title".ljust(125, b"\x00")
    s = M.parse(media)
    assert s.tags["PAYLOAD_BYTES"] == "3" and s.tags["TITLE1"] == "A title" and s.frames == 1


def test_features(spark):
    rows = [(1, None), (2, ""), (3, "é" * 40000), (4, "a"), (4, "a")]
    got = M.media_features(spark.createDataFrame(rows, "doc_id bigint, text string"), keep_media=True).collect()
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    assert len({r.feature for r in got if r.doc_id == 4}) == 1
    assert M.media_features(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def crc(bits):
    """The checksum bit by bit, from the standard's text."""
    c = 0xFFFF
    for b in bits:
        top = c >> 15 & 1
        c = c << 1 & 0xFFFF
        if top ^ b:
            c ^= 0x8005
    return c


def as_bits(data):
    return [b >> (7 - k) & 1 for b in data for k in range(8)]


def frame(head, size, body, covered):
    """A protected frame of hand-written header bytes; `covered`: bits of the body that the checksum covers."""
    body = bytes(body).ljust(size - 6, b"\x00")
    return bytes(head) + crc(as_bits(bytes(head[2:4])) + as_bits(body)[:covered]).to_bytes(2, "big") + body


# Hand-written streams: header bytes, frame bytes, first body bytes, covered bits, and what has to be found.
KNOWN = {
    "layer I stereo 384 kbit/s 48 kHz": ((0xFF, 0xFE, 0xC4, 0x00), 384, [0x21] * 40, 256, (1, 48000, 2, 384, 384)),
    "layer I joint stereo, bound 8": ((0xFF, 0xFE, 0xC4, 0x50), 384, [0x5A] * 40, 4 * (8 * 2 + 24), (1, 48000, 2, 384, 384)),
    "layer I mono 32 kHz 256 kbit/s": ((0xFF, 0xFE, 0x88, 0xC0), 384, [0x77] * 40, 128, (1, 32000, 1, 256, 384)),
    # allocations: all zero but the first subband's two (4 bits each): 11 + 12 + 4 subbands at 48 kHz, then two selections
    "layer II stereo 192 kbit/s 48 kHz": ((0xFF, 0xFC, 0xA4, 0x00), 576, [0x11] + [0] * 40, 2 * (11 * 4 + 12 * 3 + 4 * 2) + 2 * 2, (2, 48000, 2, 192, 1152)),
    "layer II mono 32 kbit/s 44.1 kHz": ((0xFF, 0xFC, 0x10, 0xC0), 104, [0x10] + [0] * 20, 2 * 4 + 6 * 3 + 2, (2, 44100, 1, 32, 1152)),
    "MPEG 2 layer II mono 64 kbit/s 24 kHz": ((0xFF, 0xF4, 0x84, 0xC0), 384, [0] * 20, 4 * 4 + 7 * 3 + 19 * 2, (2, 24000, 1, 64, 1152)),
    "MPEG 2 layer III mono 64 kbit/s 16 kHz": ((0xFF, 0xF2, 0x88, 0xC0), 288, [9] * 9, 72, (3, 16000, 1, 64, 576)),
    "MPEG 2.5 layer III stereo 16 kbit/s 8 kHz": ((0xFF, 0xE2, 0x28, 0x00), 144, [7] * 17, 136, (3, 8000, 2, 16, 576)),
    "MPEG 1 layer III stereo 128 kbit/s 44.1 kHz": ((0xFF, 0xFA, 0x90, 0x00), 417, [5] * 32, 256, (3, 44100, 2, 128, 1152)),
}


@pytest.mark.parametrize("name", KNOWN)
def test_hand_written_streams(name):
    head, size, body, covered, (layer, rate, channels, kbps, samples) = KNOWN[name]
    one = frame(head, size, body, covered)
    s = M.parse(b"junk" + one * 5, seek_every=2)
    assert (s.layer, s.rate, s.channels, s.kbps, s.samples) == (layer, rate, channels, {kbps: 5}, 5 * samples)
    assert (s.checked, s.bad_crc, s.junk_bytes, s.cut, s.offsets) == (5, 0, 4, 0, [4, 4 + 2 * size, 4 + 4 * size])
    assert s.duration == 5 * samples / rate and s.table_ok is None
    last = 6 + (covered - 1) // 8
    hurt = bytearray(one)
    hurt[last] ^= 1 << (7 - (covered - 1) % 8)  # the last covered bit
    assert M.parse(bytes(hurt) + one * 3).bad_crc == 1
    if covered // 8 + 8 < size:
        hurt = bytearray(one)
        hurt[last + 2] ^= 1  # beyond the covered bits
        assert M.parse(bytes(hurt) + one * 3).bad_crc == 0


def test_free_format():
    """Layer III at 44.1 kHz without a bitrate: 500 bytes a frame, 501 where padded."""
    plain, padded_ = (bytes((0xFF, 0xFB, pad << 1, 0x00)).ljust(500 + pad, b"\x01") for pad in (0, 1))
    s = M.parse(b"xx" + plain + padded_ + plain * 3)
    assert (s.frames, s.samples, s.junk_bytes, s.kbps) == (5, 5 * 1152, 2, {0: 5}) and s.audio_bytes == 2501


def test_tables_are_compared_with_the_stream():
    one = bytes((0xFF, 0xFB, 0x90, 0x00)).ljust(417, b"\x00")
    def vbri(frames, size):
        return (bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(32) + b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + size.to_bytes(4, "big") + frames.to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (5).to_bytes(2, "big") + (834).to_bytes(2, "big") * 2).ljust(417, b"\x00")

    good = M.parse(vbri(4, 5 * 417) + one * 4)
    assert good.vbr == {"kind": "VBRI", "bytes": 2085, "frames": 4, "toc": [834, 834]} and good.table_ok and good.frames == 4
    assert M.parse(vbri(9, 5 * 417) + one * 4).table_ok is False and M.parse(vbri(4, 99) + one * 4).table_ok is False
    media = M.write_stream(b"y" * 5000)
    assert M.parse(media).table_ok and M.parse(media[:-672]).table_ok is False


def test_seek_offsets_and_odd_rows(spark):
    """Offsets in the result lead to frames; clashing columns, null ids, repeated and very long rows."""
    rows = [(1, "a" * 300_000), (None, "b"), (None, "b"), (2, None)]
    got = M.media_features(spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id bigint, text string, media string, n_frames int"), keep_media=True, seek_every=10).collect()
    assert len(got) == 4 and len({r.media_sha256 for r in got if r.doc_id is None and r.n_bytes == 1}) == 1
    for r in got:
        assert len(r.seek_offsets) == -(-r.n_frames // 10) and r.n_samples == 1152 * r.n_frames and r.sample_rate == 48000 and r.duration_s == r.n_samples / 48000
        for k, at in enumerate(r.seek_offsets):
            assert M.header(bytes(r.media[at : at + 4])) and bytes(r.media[at + 23 : at + 24]) in (b"a", b"b", b"\xff")
