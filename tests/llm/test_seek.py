"""Seek tables, resynchronising, checksums and durations of MPEG streams, and the query."""

from __future__ import annotations

import hashlib
import json
import random
import struct
import zlib

from libgauge.llm import mpeg_audio


def test_seek_tables():
    media = mpeg_audio.store_payload(bytes(range(256)) * 500)
    x = mpeg_audio.probe(media)
    assert len(x["seek_offsets"]) == x["frames"] > 100
    assert all(mpeg_audio.parse_header(media[at : at + 4]) for at in x["seek_offsets"])
    assert len(x["vbr"]["toc"]) == 100 and x["vbr"]["toc"] == sorted(x["vbr"]["toc"]) and x["vbr"]["toc"][-1] > 200


def test_vbri_table():
    tag = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 9000, 30, 3, 2, 2, 10) + struct.pack(">HHH", 100, 200, 300)
    assert mpeg_audio._vbr(tag) == {"kind": "VBRI", "bytes": 9000, "frames": 30, "toc": [200, 400, 600], "frames_a_point": 10}
    assert mpeg_audio._vbr(tag[:28])["toc"] == [200]
    assert mpeg_audio._vbr(tag[:22] + b"\0\0" + tag[24:])["toc"] == []


def test_junk_before():
    """Header-like bytes before the stream don't lock the reader."""
    media = mpeg_audio.store_payload(random.Random(1).randbytes(5000))
    audio = media[media.index(b"\xff\xfa") :]
    clean = mpeg_audio.probe(audio)
    for junk in (b"\xff\xf3\x90\x00", b"\xff\xfb\x90\x00", b"\xff\xff\xff"):
        x = mpeg_audio.probe(junk + bytes(range(40)) + audio)
        assert (x["frames"], x["skipped"], x["vbr"]["music_ok"], x["vbr"]["tag_ok"], x["crc_bad"]) == (6, len(junk) + 40, True, True, 0)
        assert [k - len(junk) - 40 for k in x["seek_offsets"]] == clean["seek_offsets"]
    two = mpeg_audio.probe(audio[: -128] + b"\xff\xfb\x90\x00" * 3 + audio)
    assert two["frames"] == 12 + 1 and two["resyncs"] == 1  # the second table counts as a frame


def slow_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ b else 0)
    return c


def to_bits(data):
    return [b >> k & 1 for b in data for k in range(7, -1, -1)]


def layered(layer, head3, bits_of):
    """A protected Layer I or II frame at 44.1 kHz: allocation of 1 in every second place."""
    rates = {1: 12, 2: 8}  # 384 and 128 kbit/s
    head = bytes((0xFF, 0xF0 | 8 | (4 - layer) << 1, rates[layer] << 4, head3))
    allocation = "".join(f"{k % 2:0{w}b}" for k, w in enumerate(bits_of))
    size = mpeg_audio.parse_header(head)[0]
    body = int(allocation.ljust(8 * (size - 6), "0"), 2).to_bytes(size - 6, "big")
    scales = 2 * sum(k % 2 for k, w in enumerate(bits_of)) if layer == 2 else 0
    covered = to_bits(head[2:]) + to_bits(body)[: len(allocation) + scales]
    return head + slow_crc(covered).to_bytes(2, "big") + body


def test_layers_one_and_two():
    stereo_one = layered(1, 0x00, [4] * 64)
    mono_two = layered(2, 0xC0, [4] * 11 + [3] * 12 + [2] * 7)  # 128 kbit/s for one channel: 30 subbands
    stereo_two = layered(2, 0x00, [4] * 22 + [3] * 24 + [2] * 8)  # 64 each: 27 subbands
    for frame in (stereo_one, mono_two, stereo_two):
        x = mpeg_audio.probe(frame * 3)
        assert (x["frames"], x["crc_good"], x["crc_bad"]) == (3, 3, 0)
        broken = bytearray(frame * 3)
        broken[8] ^= 1
        assert mpeg_audio.probe(bytes(broken))["crc_bad"] == 1


def test_delay_and_padding():
    media = bytearray(mpeg_audio.store_payload(bytes(5000)))
    at = media.index(b"libgauge0") + 21
    media[at : at + 3] = (576 << 12 | 1000).to_bytes(3, "big")
    x = mpeg_audio.probe(bytes(media))
    assert (x["vbr"]["delay"], x["vbr"]["padding"], x["vbr"]["tag_ok"]) == (576, 1000, False)
    assert (x["frames"], x["duration"]) == (6, "667/6000")  # (6 * 1152 - 1576) / 48000


def test_query(spark, tmp_path):
    texts = ["", None, "é" * 1000, "a" * 64, "b" * 5_000_000, "x", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in mpeg_audio.op1_mpeg_audio(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        payload = b + bytes(-len(b) % 64 or (0 if b else 64))
        r, media = rows[i], mpeg_audio.store_payload(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and json.loads(r.feature)["frames"] == r.frames == len(r.seek_offsets)
    assert rows[5].feature == rows[6].feature
