"""MPEG audio columns: store bytes in an MPEG stream, read such streams back, index their frames.

Storing: MPEG-1 Layer III frames at 48 kHz whose granules code nothing, so that the whole main-data
area of a frame is ancillary data; the payload lies there.  Each frame carries its CRC-16; a Xing
frame with a table of contents and music checksum comes first; ID3v2 and ID3v1 tags stand around
the stream.  All frames but the last have 320 kbit/s, the last has the least rate that holds the
rest, so the stream has a variable bitrate.

Reading: tags are parsed and skipped, frame headers are found at the start and again after foreign bytes
(one counts when another of its version, layer and rate follows it or the stream ends there), the
checksums of the frames of all layers, of the tag and of the music are verified, and the exact duration
(samples without the encoder's delay and padding, over the rate), the offset of every frame and the
stream's own seek table (Xing, VBRI) come out.

Defined results: a null or empty payload is stored as 64 zero bytes by the query; bytes without any
frame give 0 frames, duration 0 and no seek points; a stream cut inside a frame ends before it;
free-format streams are not read; equal bytes give equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, rows_out, texts

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, Hz by rate index.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

SIDE = 32
OVERHEAD = 4 + 2 + SIDE
OWNER = b"payload-bytes\x00"


def _table(poly: int, reflected: bool) -> list[int]:
    out = []
    for i in range(256):
        c = i if reflected else i << 8
        for _ in range(8):
            c = (c >> 1) ^ (poly if c & 1 else 0) if reflected else ((c << 1) ^ (poly if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


FRAME_TABLE, MUSIC_TABLE = _table(0x8005, False), _table(0xA001, True)


@lru_cache(1 << 12)
def frame_crc(covered: bytes) -> int:
    """CRC-16 of a Layer III frame: the last two header bytes and the side information."""
    c = 0xFFFF
    for b in covered:
        c = ((c << 8) & 0xFFFF) ^ FRAME_TABLE[(c >> 8) ^ b]
    return c


@lru_cache(1)
def _music_rows() -> np.ndarray:
    """Row k: what a byte at distance k from the end adds to the CRC; the polynomial's period is 32767."""
    step, rows = np.array(MUSIC_TABLE, np.uint16), np.empty((32767, 256), np.uint16)
    rows[0] = step
    for k in range(1, 32767):
        rows[k] = (rows[k - 1] >> 8) ^ step[rows[k - 1] & 255]
    return rows.ravel()


def music_crc(data: bytes) -> int:
    """Reflected CRC-16 with start 0, as sums of table rows."""
    if not data:
        return 0
    rows, out, n = _music_rows(), 0, len(data)
    for lo in range(0, n, 1 << 18):
        part = np.frombuffer(data, np.uint8, min(1 << 18, n - lo), lo)
        away = (n - 1 - lo - np.arange(len(part), dtype=np.int64)) % 32767
        out ^= int(np.bitwise_xor.reduce(rows[away * 256 + part]))
    return out


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def _header(index: int) -> bytes:
    return bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0))


def _frame(index: int, main: bytes) -> bytes:
    """A silent, CRC-protected Layer III frame whose main data is ancillary."""
    head, side = _header(index), bytes(SIDE)
    return head + struct.pack(">H", frame_crc(head[2:] + side)) + side + main.ljust(3 * KBPS[1, 3][index] - OVERHEAD, b"\0")


def store_payload(payload: bytes) -> bytes:
    """An MPEG stream that holds the payload losslessly."""
    room = 3 * 320 - OVERHEAD
    full, rest = divmod(len(payload), room)
    frames = [_frame(14, payload[i * room : (i + 1) * room]) for i in range(full)]
    if rest or not full:
        index = next(i for i in range(1, 15) if 3 * KBPS[1, 3][i] - OVERHEAD >= rest)
        frames.append(_frame(index, payload[full * room :]))
    music = b"".join(frames)
    xing_size = 3 * KBPS[1, 3][6]
    total, n = xing_size + len(music), len(frames)
    toc = bytes(min(255, 256 * (xing_size + min(len(music), 960 * (i * n // 100))) // total) for i in range(100))
    tag = b"Xing" + struct.pack(">III", 15, n, total) + toc + struct.pack(">I", 0)
    tag += b"libgauge0" + bytes(19) + struct.pack(">IH", total, music_crc(music))
    xing = _header(6) + struct.pack(">H", frame_crc(_header(6)[2:] + bytes(SIDE))) + bytes(SIDE) + tag
    xing = (xing + struct.pack(">H", music_crc(xing))).ljust(xing_size, b"\0")
    length = str(24 * n).encode()
    parts = b"".join(name + _synchsafe(len(x)) + b"\0\0" + x for name, x in ((b"TLEN", b"\x03" + length), (b"PRIV", OWNER + struct.pack(">Q", len(payload)))))
    return b"ID3\x04\0\0" + _synchsafe(len(parts)) + parts + xing + music + (b"TAG" + b"payload").ljust(128, b"\0")


@lru_cache(1 << 12)
def parse_header(head: bytes) -> tuple[int, int, int, int, bool, int, tuple] | None:
    """(bytes, samples, Hz, side bytes, has CRC, kbit/s, what all frames share) of a frame header."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(head[1] >> 3 & 3)
    layer, rate, bits = 4 - (head[1] >> 1 & 3), head[2] >> 2 & 3, head[2] >> 4
    if version is None or layer == 4 or rate == 3 or bits in (0, 15):
        return None
    kbps, hz, pad = KBPS[min(2, int(version)), layer][bits], HZ[version][rate], head[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    mono = head[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return size, samples, hz, side, not head[1] & 1, kbps, (version, layer, hz)


# Fixed values of ISO/IEC 11172-3 and 13818-3, Layer II: bits of a subband's allocation, as runs (bits, subbands).
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


def allocation_bits(version: float, layer: int, hz: int, kbps: int, channels: int) -> list[int]:
    """Bits of each subband's allocation."""
    if layer == 1:
        return [4] * 32
    each = kbps // channels
    if version != 1:
        name = "low"
    elif each <= 48:
        name = "d" if hz == 32000 else "c"
    else:
        name = "a" if hz == 48000 or each <= 80 else "b"
    return [bits for bits, n in ALLOCATION[name] for _ in range(n)]


def checked_bits(frame: bytes) -> int | None:
    """How many bits after the checksum it covers in a Layer I or II frame; None if the frame is too short."""
    seen = parse_header(frame[:4])
    version, layer, hz = seen[6]
    mode, channels = frame[3] >> 6, 1 if frame[3] >> 6 == 3 else 2
    widths = allocation_bits(version, layer, hz, seen[5], channels)
    joint = min(len(widths), 4 * (1 + (frame[3] >> 4 & 3))) if mode == 1 else len(widths)
    total, at = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6)
    used = scales = 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < joint else 1):
            used += width
            if used > at:
                return None
            if total >> (at - used) & ((1 << width) - 1):
                scales += 2 * (1 if band < joint else channels)
    used += scales if layer == 2 else 0
    return used if used <= at else None


def bits_crc(start: bytes, data: bytes, bits: int) -> int:
    """CRC-16 of ``start`` and the first ``bits`` of ``data``."""
    c = frame_crc(start + data[: bits // 8])
    for k in range(bits % 8):
        top = c >> 15 ^ (data[bits // 8] >> (7 - k) & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def crc_holds(frame: bytes, side: int) -> bool:
    """Is a protected frame's checksum right?"""
    told = int.from_bytes(frame[4:6], "big")
    if side:
        return frame_crc(frame[2:4] + frame[6 : 6 + side]) == told
    bits = checked_bits(frame)
    return bits is not None and bits_crc(frame[2:4], frame[6:], bits) == told


def parse_tags(data: bytes) -> tuple[dict[str, bytes], int, int]:
    """ID3v2 frames of the front tag, and where the audio begins and ends."""
    tags: dict[str, bytes] = {}
    begin, end = 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10 and max(data[6:10]) < 128:
        size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
        begin = min(end, 10 + size + (10 if data[5] & 16 else 0))
        at, stop = 10, min(end, 10 + size)
        while at + 10 <= stop and data[at : at + 4].strip(b"\0"):
            raw = data[at + 4 : at + 8]
            n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if data[3] == 4 else int.from_bytes(raw, "big")
            tags[data[at : at + 4].decode("latin-1")] = data[at + 10 : min(stop, at + 10 + n)]
            at += 10 + n
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ")
    return tags, begin, end


def probe(data: bytes) -> dict:
    """Frame index, durations, checksums, tags and main data of an MPEG stream."""
    tags, at, end = parse_tags(data)
    starts, main, xing = [], [], None
    samples = bad = good = resyncs = skipped = 0
    shared, rates, hz = None, set(), 0
    synced, lost = False, False
    while at + 4 <= end:
        seen = parse_header(data[at : at + 4])
        fits = seen is not None and at + seen[0] <= end
        if fits and synced:
            fits = seen[6] == shared
        elif fits and at + seen[0] + 4 <= end:
            after = parse_header(data[at + seen[0] : at + seen[0] + 4])
            fits = after is not None and after[6] == seen[6]
        if not fits:
            lost, synced = lost or synced, False
            step = data.find(b"\xff", at + 1, end)
            skipped += (step if step >= 0 else end) - at
            if step < 0:
                break
            at = step
            continue
        size, count, hz, side, protected, kbps, shared = seen
        resyncs += lost
        synced, lost = True, False
        body = at + 4 + 2 * protected
        if protected:
            right = crc_holds(data[at : at + size], side)
            good, bad = good + right, bad + (not right)
        mark = data[body + side : body + side + 4]
        if not starts and xing is None and mark in (b"Xing", b"Info"):
            xing = (at, data[body + side : at + size], body + side - at)
        elif not starts and xing is None and data[at + 36 : at + 40] == b"VBRI":
            xing = (at, data[at + 36 : at + size], 36)
        else:
            starts.append(at)
            samples += count
            rates.add(kbps)
            main.append(data[body + side : at + size])
        at += size
    resyncs += lost  # foreign bytes up to the end
    table = _vbr(xing[1]) if xing else {}
    whole = b"".join(main)
    if "music_crc" in table:
        first = starts[0] if starts else end
        table["music_ok"] = music_crc(data[first:end]) == table.pop("music_crc")
        table["tag_ok"] = music_crc(data[xing[0] : xing[0] + xing[2] + 154]) == table.pop("tag_crc")
    played = max(0, samples - table.get("delay", 0) - table.get("padding", 0))
    length = Fraction(played, hz) if hz else Fraction(0)
    private = tags.get("PRIV", b"")
    size = int.from_bytes(private[len(OWNER) :], "big") if private.startswith(OWNER) else len(whole)
    return {
        "frames": len(starts), "samples": samples, "hz": hz, "kbps": sorted(rates), "crc_good": good, "crc_bad": bad, "resyncs": resyncs, "skipped": skipped,
        "vbr": table, "duration": f"{length.numerator}/{length.denominator}", "duration_us": played * 1_000_000 // hz if hz else 0, "seek_offsets": starts, "tags": sorted(tags), "payload": whole[:size],
    }


def _vbr(tag: bytes) -> dict:
    """A Xing, Info or VBRI table."""
    if tag[:4] == b"VBRI" and len(tag) >= 26:
        points, scale, n, each = (int.from_bytes(tag[k : k + 2], "big") for k in (18, 20, 22, 24))
        toc = [scale * int.from_bytes(tag[k : k + n], "big") for k in range(26, 26 + n * points, n or 1) if k + n <= len(tag)]
        return {"kind": "VBRI", "bytes": int.from_bytes(tag[10:14], "big"), "frames": int.from_bytes(tag[14:18], "big"), "toc": toc, "frames_a_point": each}
    out: dict = {"kind": tag[:4].decode("latin-1")}
    flags, at = int.from_bytes(tag[4:8], "big"), 8
    for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
        if flags & bit and at + n <= len(tag):
            out[name] = list(tag[at : at + n]) if name == "toc" else int.from_bytes(tag[at : at + n], "big")
            at += n
    if at + 36 <= len(tag) and flags == 15 and tag[at : at + 9].strip(b"\0"):
        out |= {"encoder": tag[at : at + 9].decode("latin-1"), "delay": int.from_bytes(tag[at + 21 : at + 24], "big") >> 12, "padding": int.from_bytes(tag[at + 21 : at + 24], "big") & 0xFFF, "music_crc": int.from_bytes(tag[at + 32 : at + 34], "big"), "tag_crc": int.from_bytes(tag[at + 34 : at + 36], "big")}
    return out


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("duration_us", pa.int64()), ("frames", pa.int64()), ("seek_offsets", pa.list_(pa.int64())), ("feature", pa.string())])


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text, padded to 64 bytes, as an MPEG stream."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, len(t), store_payload(padded(t))) for b in batches for i, t in zip(b.column("doc_id").to_pylist(), texts(b, "text")))
        yield from rows_out(MEDIA, rows, size=lambda r: len(r[2]))

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def probe_media(df: DataFrame) -> DataFrame:
    """Frame index and features of the streams in ``media``; null counts as no bytes."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, n, media in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist()):
                    media = media or b""
                    x = probe(media)
                    payload = x.pop("payload")
                    yield (i, n, payload, len(media), hashlib.sha256(media).hexdigest(), x["duration_us"], x["frames"], x["seek_offsets"], json.dumps(x, separators=(",", ":"), sort_keys=True))

        yield from rows_out(FOUND, rows(), size=lambda r: len(r[2]) + 9 * len(r[7]))

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, duration_us long, frames long, seek_offsets array<long>, feature string")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probe_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    size = F.octet_length("payload")
    return found.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature", "duration_us", "frames", "seek_offsets",
    )
