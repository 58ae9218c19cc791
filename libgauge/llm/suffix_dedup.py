"""Repeated substrings, by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else, in the same
text or another; strings never cross texts.  All starts of such strings must be found.

The cover.  D is a perfect difference set of period v = 57 (8 residues, Singer): for any two positions
i, j there is a shift s < v with (i + s) mod v and (j + s) mod v in D.  If the strings of ``width``
bytes at i and j are equal, so are the s bytes before the sampled positions i + s and j + s, and the first
width - s bytes of the suffixes that begin there.  Ranks of the sample's suffixes therefore decide every tie:

1. Which samples can be tied at all.  Hashes of the first width - v + 1 = 144 bytes of each sampled
   suffix are sorted, a range of them at a time.  Equal strings have equal hashes, so this loses none; a
   false tie only costs the next step some bytes.  A text that is there several times (by its BLAKE2b
   digest of 256 bits) goes whole and takes part in what follows once.
2. Suffix buckets.  Equal samples share the least hash of a 16-gram among their 144 bytes; it names their
   bucket.  Neighbouring samples mostly share it too, so that a bucket gets pieces of text: some samples
   with up to v - 1 bytes before the first and ``width`` bytes from the last on.  One bucket at a time, and
   in it one least hash after the other, the sampled suffixes are sorted by their bytes and given ranks for
   every depth, and so are the bytes before them, read backwards.  The string that begins s bytes
   before a sample is repeated if another sample has the same rank at depth width - s and the same s bytes
   before it.  All comparisons are of bytes; no result rests on a hash of part of a text.
3. What is found goes back to the texts as bits over the pieces' bytes.

Memory.  Texts travel as chunks of about CHUNK bytes, saved once in a table bucketed by chunk, so that
later steps find their replies without moving texts again; hashes are made for STEP positions and dealt out
for SEGMENT positions at a time, whatever the length of a text.  Each chunk has a fixed number of buckets, so the rows dealt out
grow with the input.  Pieces that are equal in a chunk are sent once.  A bucket sorts the pieces of at most
FAN_IN chunks; with more chunks, pieces left distinct meet in further rounds, so that a passage common to
all chunks never comes to one task more than FAN_IN times.

Defined results: a null text counts as empty; texts shorter than ``width`` lose nothing; repeated
rows lose everything (if long enough); an empty table gives an empty result; other columns are
ignored by ``dedup`` and kept by ``cut_repeats``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, bounded_batches, fresh, rows_out, setting, texts

WIDTH = 200
ORDER = 7
PERIOD = ORDER * ORDER + ORDER + 1
CHUNK, SEGMENT, STEP = 4 << 20, 4 << 20, 1 << 19
#: Buckets of hashes and of suffixes: so many at least, and one for so many bytes of text; chunks whose pieces meet in one task.
BUCKETS, BUCKET_BYTES, FAN_IN = 512, 128 << 20, 4096
#: Spark writes no more buckets of a table.
MOST_HOMES = 100_000
GRAM = 16
#: A piece's first and last sample are less than this apart (a multiple of the period).
SPAN = 64 * PERIOD
#: So many samples are sorted at a time, unless more share one least hash.
SORTED = 1 << 16
#: Rows of their matrix that are built or compared at a time.
ROWS_AT_ONCE = 1 << 13
SAMPLE_BITS = 40


def difference_cover(q: int = ORDER) -> np.ndarray:
    """A perfect difference set of q + 1 residues modulo q * q + q + 1 (Singer): the powers of a root
    of a cubic over GF(q) that lie in a plane.  q must be prime."""
    n = q * q + q + 1
    for a, b, c in itertools.product(range(q), range(q), range(1, q)):
        t, found = (1, 0, 0), []
        for i in range(n):
            if t[2] == 0:
                found.append(i)
            t = (c * t[2] % q, (t[0] + b * t[2]) % q, (t[1] + a * t[2]) % q)
        if len(found) == q + 1 and len({(i - j) % n for i in found for j in found}) == n:
            return np.array(found)
    raise ValueError(f"no difference set of order {q}")


COVER = np.zeros(PERIOD, bool)
COVER[difference_cover()] = True


class Rolling:
    """Hashes of all windows of a byte array: sums of random byte values times powers, then mixed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 60, 1 << 62)) * 8 + 5
        self.base, self.inverse = np.uint64(base % 2**64), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, x in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def windows(self, data: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows at these positions (all if None)."""
        n = len(data) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._powers(STEP + 1024 if len(data) <= STEP + 1024 else len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=sums[1:])
        if at is None:
            h = (sums[width:] - sums[:-width]) * self.down[:n]
        else:
            h = (sums[at + width] - sums[at]) * self.down[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
        return h


@lru_cache(1)
def hashes() -> tuple[Rolling, Rolling]:
    return Rolling(11), Rolling(23)


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte planes apart, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def bucket_edges(buckets: int, bits: int) -> np.ndarray:
    """The least value of each bucket but the first; buckets are equal ranges of ``bits`` bits."""
    return np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)


def deal(values: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted values by bucket."""
    cuts = np.r_[0, np.searchsorted(values, bucket_edges(buckets, bits)), len(values)]
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            yield k, values[cuts[k] : cuts[k + 1]]


def tied(buckets: DataFrame) -> DataFrame:
    """Rows (bucket, chunk, seg, blob of distinct sorted values) to rows (chunk, seg, bucket, bits):
    a bit for each value of the blob, set if the value is in another blob too.  One bucket is sorted
    at a time; blobs without a set bit give no row."""

    def one(table: pa.Table) -> pa.Table:
        blobs = [unpack_sorted(x) for x in table.column("blob").to_pylist()]
        values = np.concatenate(blobs)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(len(values), bool)
        hit[order] = np.r_[same, False] | np.r_[False, same]
        parts = np.split(hit, np.cumsum([len(b) for b in blobs])[:-1])
        some = [k for k, p in enumerate(parts) if p.any()]
        kept = table.select(["chunk", "seg", "bucket"]).take(pa.array(some, pa.int64()))
        return kept.append_column("bits", pa.array([np.packbits(parts[k]).tobytes() for k in some], pa.binary()))

    return buckets.groupBy("bucket").applyInArrow(one, "chunk long, seg int, bucket int, bits binary")


def untangle(values: np.ndarray, replies: dict[int, bytes], buckets: int, bits: int) -> np.ndarray:
    """The bits of one segment's distinct sorted values."""
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(replies[k], np.uint8), count=len(v)).astype(bool) if k in replies else np.zeros(len(v), bool) for k, v in deal(values, buckets, bits))])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    n, have = len(h) - width + 1, 1
    while 2 * have <= width:
        h, have = np.minimum(h[: len(h) - have], h[have:]), 2 * have
    return np.minimum(h[:n], h[width - have : width - have + n])


class Chunk:
    """The texts of a chunk, end to end."""

    def __init__(self, lengths: list[int], data: bytes, width: int, bits: int, buckets: int = BUCKETS):
        self.data, self.width, self.bits, self.buckets = np.frombuffer(data, np.uint8), width, bits, buckets
        self.lengths = np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.short = width - PERIOD + 1

    def segments(self) -> Iterator[tuple[int, int, int]]:
        for seg, lo in enumerate(range(0, len(self.data), SEGMENT)):
            yield seg, lo, min(len(self.data), lo + SEGMENT)

    def steps(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        for at in range(lo, hi, STEP):
            yield at, min(hi, at + STEP)

    def sampled(self, lo: int, hi: int) -> np.ndarray:
        """Positions of the cover sample from lo to hi, of texts long enough for its strings."""
        a, b = np.searchsorted(self.ends, lo, "right"), np.searchsorted(self.starts, hi, "left")
        start, last = self.starts[a:b], self.ends[a:b] - self.short
        first = np.maximum(0, lo - start) // PERIOD
        periods = np.maximum(0, (np.minimum(hi - 1, last) - start) // PERIOD + 1 - first)
        inside = np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods)
        base = np.repeat(start + first * PERIOD, periods) + inside * PERIOD
        at = (base[:, None] + np.flatnonzero(COVER)).ravel()
        return at[(at >= lo) & (at < hi) & (at <= np.repeat(np.repeat(last, periods), COVER.sum()))]

    def samples(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover sample in a segment and their hashes."""
        at, found = self.sampled(lo, hi), [np.zeros(0, np.uint64)]
        for a, b in self.steps(lo, hi):
            some = at[slice(*np.searchsorted(at, (a, b)))] - a
            if len(some):
                found.append(hashes()[0].windows(self.data[a : b + self.short - 1], self.short, some))
        return at, np.concatenate(found) >> np.uint64(64 - self.bits)

    def tied(self, replies: dict[int, dict[int, bytes]]) -> np.ndarray:
        """Positions of the samples that step 1 couldn't tell apart from others."""
        found = [np.zeros(0, np.int64)]
        for seg, lo, hi in self.segments():
            at, h = self.samples(lo, hi)
            values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            ties = (counts > 1) | untangle(values, replies.get(seg, {}), self.buckets, self.bits)
            found.append(at[ties[inverse]])
        return np.concatenate(found)

    def pieces(self, at: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The tied samples at these positions as pieces, without texts of which another copy takes part.
        Columns: lo and hi in the chunk, lead and tail (first and last sample, from lo), phase (the first
        one's residue), key (the least hash that they share, halved)."""
        doc = np.searchsorted(self.ends, at, "right")
        at, doc = at[~out[doc]], doc[~out[doc]]
        if not len(at):
            return np.zeros((0, 6), np.int64)
        keys = np.zeros(len(at), np.uint64)
        for lo, hi in self.steps(0, len(self.data)):
            a, b = np.searchsorted(at, (lo, hi))
            if a < b:
                least = sliding_min(hashes()[1].windows(self.data[lo : hi + self.short - 1], GRAM), self.short - GRAM + 1)
                keys[a:b] = least[at[a:b] - lo]
        run = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
        begin = np.repeat(at[run], np.diff(np.r_[run, len(at)]))
        place = (at - begin) // SPAN
        first = np.flatnonzero(np.r_[True, (begin[1:] != begin[:-1]) | (place[1:] != place[:-1])])
        last = np.r_[first[1:], len(at)] - 1
        lo = np.maximum(self.starts[doc[first]], at[first] - PERIOD + 1)
        hi = np.minimum(self.ends[doc[first]], at[last] + self.width)
        return np.c_[lo, hi, at[first] - lo, at[last] - lo, (at[first] - self.starts[doc[first]]) % PERIOD, (keys[first] >> np.uint64(1)).astype(np.int64)]

    def blobs(self, pieces: np.ndarray) -> dict[int, dict[tuple, list[int]]]:
        """Distinct pieces by bucket, with the places where each is."""
        found: dict[int, dict[tuple, list[int]]] = defaultdict(dict)
        whole = self.data.tobytes()
        for lo, hi, lead, tail, phase, key in pieces.tolist():
            found[key % self.buckets].setdefault((whole[lo:hi], lead, tail, phase, key), []).append(lo)
        return found

    def confirmed(self, pieces: np.ndarray, replies: dict[int, list[bytes]]) -> np.ndarray:
        """Which bytes lie in a repeated string, by the starts that the buckets found."""
        found = [np.zeros(0, np.int64)]
        for bucket, distinct in self.blobs(pieces).items():
            ends = np.cumsum([len(same[0]) for same in distinct])
            first = np.array([places[0] for places in distinct.values()])
            told = np.zeros(ends[-1], bool)
            for bits in replies.get(bucket, ()):
                told |= np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8), count=len(told)).astype(bool)
            at = np.flatnonzero(told)
            owner = np.searchsorted(ends, at, "right")
            found.append(first[owner] + at - np.r_[0, ends][owner])
            found += [lo + np.arange(len(same[0]) - self.width + 1) for same, places in distinct.items() if len(places) > 1 for lo in places]
        n, at = len(self.data) + 1, np.concatenate(found)
        edge = np.bincount(at, minlength=n) - np.bincount(at + self.width, minlength=n)
        return np.cumsum(edge[:-1]) > 0


def windows_of(padded: np.ndarray, at: np.ndarray, width: int, valid: np.ndarray, backwards: bool = False) -> np.ndarray:
    """Rows of ``width`` bytes from these places, zeros beyond their valid length, and that length in two more bytes.
    Built in blocks of rows, so that little stands beside the matrix itself."""
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    rows = np.empty((len(at), width + 2), np.uint8)
    for lo in range(0, len(at), ROWS_AT_ONCE):
        part = slice(lo, lo + ROWS_AT_ONCE)
        block = view[at[part]]
        block = block[:, ::-1] if backwards else block
        rows[part, :width] = np.where(np.arange(width) < valid[part, None], block, np.uint8(0))
    rows[:, width], rows[:, width + 1] = valid >> 8, valid & 255
    return rows


def ranked(strings: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes as ``windows_of`` makes them (the shorter first in a tie), and how many
    bytes each shares with the one before it in that order."""
    width = strings.shape[1] - 2
    order = np.argsort(strings.view(f"S{width + 2}").ravel(), kind="stable")
    shared = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), ROWS_AT_ONCE):
        this, last = order[lo : lo + ROWS_AT_ONCE], order[lo - 1 : lo - 1 + ROWS_AT_ONCE][: len(order) - lo]
        differ = strings[this, :width] != strings[last, :width]
        shared[lo : lo + ROWS_AT_ONCE] = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(valid[this], valid[last]))
    return order, shared


def repeated_starts(data: np.ndarray, meta: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Positions in ``data`` at which a string of ``width`` bytes begins that begins at another one too.
    Pieces (length, lead, tail, phase, ...) begin at ``starts``; their samples share a least hash or more."""
    spans = meta[:, 2] - meta[:, 1] + 1
    # Each piece's samples, one residue of the cover after the other: no array has a number for every byte.
    residues = np.flatnonzero(COVER)
    first = ((residues - meta[:, 3:4]) % PERIOD).ravel()
    times = np.maximum(0, -((first - np.repeat(spans, len(residues))) // PERIOD))
    owner = np.repeat(np.arange(len(times)), times)
    inside = first[owner] + PERIOD * (np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times))
    piece = owner // len(residues)
    at = starts[piece] + meta[piece, 1] + inside
    before = np.minimum(PERIOD - 1, at - starts[piece])
    after = np.minimum(width, starts[piece] + meta[piece, 0] - at)
    padded = np.concatenate([np.zeros(PERIOD - 1, np.uint8), data, np.zeros(width, np.uint8)])
    order, shared = ranked(windows_of(padded, at + PERIOD - 1, width, after), after)
    short = width - PERIOD + 1
    tie = (shared >= short) | np.r_[shared[1:] >= short, False]
    shared = np.where(np.r_[False, tie[:-1]], shared, 0)[tie]
    order = order[tie]
    if not len(order):
        return order
    at, before, after = at[order], before[order], after[order]
    left_order, left_shared = ranked(windows_of(padded, at, PERIOD - 1, before, backwards=True), before)
    found, name = np.zeros(len(data), bool), np.zeros(len(at), np.int64)
    for s in range(PERIOD):
        name[left_order] = np.cumsum(left_shared < s) if s else 0
        fits = np.flatnonzero((before >= s) & (after >= width - s))
        if not len(fits):
            continue
        both = np.cumsum(shared < width - s)[fits] * (len(at) + 1) + name[fits]
        o = np.argsort(both, kind="stable")
        same = both[o[1:]] == both[o[:-1]]
        found[at[fits[o[np.r_[same, False] | np.r_[False, same]]]] - s] = True
    return np.flatnonzero(found)


#: Of each piece: length, lead, tail, phase, chunk (-1: no reply wanted), bytes of its blob, place in that, key.
META = 8
PIECES_DDL = "bucket int, salt int, n int, blob binary"
PIECE_ROWS = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])
SETTLED_DDL = PIECES_DDL + ", chunk long, bits binary"


def pack_pieces(meta: np.ndarray, data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(meta.T, np.int64).tobytes() + data)


def unpack_pieces(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(whole[: 8 * META * n], np.int64).reshape(META, n).T, np.frombuffer(whole, np.uint8)[8 * META * n :]


def settle(rows: DataFrame, width: int, more: bool) -> DataFrame:
    """Sort one bucket of pieces at a time.  Rows with bits answer a chunk: a bit for each byte of the blob
    it sent to the bucket, set where a repeated string begins.  With ``more``, rows with a blob hold the
    distinct pieces, for a round with those of other chunks."""

    def one(table: pa.Table) -> pa.Table:
        parts = [unpack_pieces(n, blob) for n, blob in zip(table.column("n").to_pylist(), table.column("blob").to_pylist())]
        meta, whole = np.concatenate([m for m, _ in parts]), b"".join(d for _, d in parts)
        del parts
        data = np.frombuffer(whole, np.uint8)
        starts = np.cumsum(meta[:, 0]) - meta[:, 0]
        groups = defaultdict(list)
        for k, (lo, n, *shape) in enumerate(np.c_[starts, meta[:, :4]].tolist()):
            groups[whole[lo : lo + n], *shape].append(k)
        hit = np.zeros(len(data), bool)
        for same in groups.values():
            if len(same) > 1:
                for k in same:
                    hit[starts[k] : starts[k] + meta[k, 0] - width + 1] = True
        distinct = np.array([same[0] for same in groups.values()], np.int64)
        distinct = distinct[np.argsort(meta[distinct, 7], kind="stable")]
        edges = np.flatnonzero(np.r_[True, np.diff(meta[distinct, 7]) != 0, True])
        weight = np.r_[0, np.cumsum((meta[distinct, 2] - meta[distinct, 1]) // 7 + 1)]  # about its samples
        lo = 0
        while lo < len(edges) - 1:
            hi = max(lo + 1, int(np.searchsorted(weight[edges], weight[edges[lo]] + SORTED, "right")) - 1)
            some = distinct[edges[lo] : edges[hi]]
            lo = hi
            if len(some) > 1 or meta[some[0], 2] > meta[some[0], 1]:
                local = np.cumsum(meta[some, 0]) - meta[some, 0]
                text = np.frombuffer(b"".join(whole[starts[k] : starts[k] + meta[k, 0]] for k in some), np.uint8)
                found = repeated_starts(text, meta[some], local, width)
                owner = np.searchsorted(local, found, "right") - 1
                hit[starts[some[owner]] + found - local[owner]] = True
        masks: dict[int, np.ndarray] = {}
        for k in np.flatnonzero((meta[:, 4] >= 0) & (np.add.reduceat(hit, starts) > 0)):
            n, _, _, _, chunk, total, offset, _ = meta[k].tolist()
            masks.setdefault(chunk, np.zeros(total, bool))[offset : offset + n] = hit[starts[k] : starts[k] + n]
        bucket = table.column("bucket")[0].as_py()
        out = [(bucket, 0, 0, None, c, zstandard.ZstdCompressor(level=1).compress(np.packbits(m).tobytes())) for c, m in masks.items()]
        if more:
            left = meta[distinct].copy()
            left[[len(groups[whole[starts[k] : starts[k] + meta[k, 0]], *meta[k, 1:4].tolist()]) > 1 for k in distinct], 4] = -1
            out.append((bucket, table.column("salt")[0].as_py(), len(left), pack_pieces(left, b"".join(whole[starts[k] : starts[k] + meta[k, 0]] for k in distinct)), None, None))
        schema = pa.schema([*PIECE_ROWS, ("chunk", pa.int64()), ("bits", pa.binary())])
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return rows.groupBy("bucket", "salt").applyInArrow(one, SETTLED_DDL)


def whole_characters(data: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Cover only characters that are covered with all their bytes."""
    if not len(data):
        return covered
    char = np.cumsum((data & 0xC0) != 0x80) - ((data[0] & 0xC0) != 0x80)
    return (np.bincount(char, ~covered) == 0)[char]


CHUNKS = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("prints", pa.list_(pa.binary())), ("data", pa.binary())])
CHUNK_DDL = "chunk long, ids array<long>, lengths array<long>, prints array<binary>, data binary"
DEALT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("seg", pa.int32()), ("blob", pa.binary())])
DEALT_DDL = "bucket int, chunk long, seg int, blob binary"
KEPT = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_sha256", pa.string()), ("kept", pa.string())])
KEPT_DDL = "chunk long, place int, doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string, kept string"


def to_chunks(rows: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows (doc_id, text) to chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 20, itertools.count()
        held: list[tuple] = []

        def close() -> tuple:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(h[1] for h in held))
            row = (base + next(k), [h[0] for h in held], [len(h[1]) for h in held], [hashlib.blake2b(h[1], digest_size=32).digest() for h in held], data)
            held.clear()
            return row

        def chunks():
            size = 0
            for b in batches:
                for row in zip(b.column("doc_id").to_pylist(), texts(b, "text")):
                    held.append(row)
                    size += len(row[1]) + 64
                    if size >= chunk_bytes:
                        yield close()
                        size = 0
            if held:
                yield close()

        yield from rows_out(CHUNKS, chunks(), size=lambda r: len(r[4]) + 64 * len(r[1]))

    return rows.mapInArrow(run, CHUNK_DDL)


def chunk_table(rows: DataFrame, work: Workspace, total: int, chunk_bytes: int = CHUNK, most_homes: int = MOST_HOMES) -> tuple[DataFrame, int]:
    """The chunks of rows with ``total`` bytes of text, saved in buckets by chunk, and the number of buckets."""
    homes = min(most_homes, max(total // (24 << 20), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # with fewer, joins would deal the texts out again
    return work.save_dealt(to_chunks(rows, chunk_bytes).repartition(homes, "chunk"), "chunks", homes, "chunk", "uncompressed"), homes


def _on_chunks(df: DataFrame, width: int, bits: int, buckets: int, schema: pa.Schema, ddl: str, make: Callable) -> DataFrame:
    """mapInArrow over chunks; make gives the rows of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    yield from make(r, Chunk(r["lengths"], zstandard.ZstdDecompressor().decompress(r["data"]), width, bits, buckets))

        yield from rows_out(schema, rows(), size=lambda r: sum(len(x) for x in r if isinstance(x, (bytes, str, list))))

    return df.mapInArrow(run, ddl)


def dedup(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, characters: bool = False, chunk_bytes: int = CHUNK, fan_in: int = FAN_IN, bucket_bytes: int = BUCKET_BYTES, most_homes: int = MOST_HOMES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans ([start, length] in bytes), kept_sha256, kept.

    ``kept`` is null unless ``keep_text``.  With ``characters`` only characters covered with all their
    bytes go, so that what is left is text.
    """
    if width < PERIOD + GRAM:
        raise ValueError(f"width must be at least {PERIOD + GRAM}")
    spark, work = df.sparkSession, Workspace(df.sparkSession, "suffixes")
    bounded_batches(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, _ = chunk_table(rows, work, total, chunk_bytes, most_homes)
    result = work.save(_cut_chunks(chunks, work, width, total, keep_text, characters, fan_in, bucket_bytes).drop("chunk", "place"), "result")
    work.keep("result")
    return result


def _cut_chunks(chunks: DataFrame, work: Workspace, width: int, total: int, keep_text: bool, characters: bool, fan_in: int = FAN_IN, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    bits, buckets = min(63, max(SAMPLE_BITS, total.bit_length() + 10)), max(BUCKETS, total // bucket_bytes)

    def sampled(r: dict, c: Chunk):
        for seg, lo, hi in c.segments():
            for bucket, values in deal(distinct_sorted(c.samples(lo, hi)[1]), buckets, bits):
                yield bucket, r["chunk"], seg, pack_sorted(values)

    ties = work.save(tied(_on_chunks(chunks.select("chunk", "lengths", "data"), width, bits, buckets, DEALT, DEALT_DDL, sampled)), "ties")
    replied = ties.groupBy("chunk").agg(F.collect_list(F.struct("seg", "bucket", "bits")).alias("ties"))
    # Copies inside a chunk are known there: a print comes once from each chunk, however common it is.
    prints = chunks.select("chunk", F.explode(F.array_distinct("prints")).alias("print"))
    owners = prints.groupBy("print").agg(F.min("chunk").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("print", "first")
    copies = prints.join(owners, "print").groupBy("chunk").agg(F.collect_list(F.struct("print", (F.col("first") != F.col("chunk")).alias("again"))).alias("copies"))
    told = chunks.join(replied.join(work.save(copies, "copies"), "chunk", "full").hint("shuffle_hash"), "chunk", "left")

    def sent(r: dict, c: Chunk):
        elsewhere = {bytes(x["print"]): x["again"] for x in r["copies"] or ()}
        count, met = Counter(r["prints"]), set()
        copied, again = np.zeros(len(c.lengths), bool), np.zeros(len(c.lengths), bool)
        for place, p in enumerate(r["prints"]):
            copied[place] = count[p] > 1 or p in elsewhere
            again[place] = p in met or elsewhere.get(p, False)
            met.add(p)
        replies: dict[int, dict[int, bytes]] = {}
        for x in r["ties"] or ():
            replies.setdefault(x["seg"], {})[x["bucket"]] = x["bits"]
        pieces = c.pieces(c.tied(replies), again)
        yield -1, r["chunk"], len(pieces), zstandard.ZstdCompressor(level=1).compress(np.packbits(copied).tobytes().ljust(len(copied), b"\0") + np.ascontiguousarray(pieces.T).tobytes())
        for bucket, distinct in c.blobs(pieces).items():
            total, offset, meta = sum(len(same[0]) for same in distinct), 0, []
            for (text, *shape, key), places in distinct.items():
                # What is there twice in the chunk is known to be repeated; it goes out for the others' sake.
                meta.append((len(text), *shape, -1 if len(places) > 1 else r["chunk"], total, offset, key))
                offset += len(text)
            yield bucket, r["chunk"], len(meta), pack_pieces(np.array(meta, np.int64), b"".join(same[0] for same in distinct))

    dealt = work.save(_on_chunks(told.select("chunk", "lengths", "prints", "data", "ties", "copies"), width, bits, buckets, SENT, "bucket int, chunk long, n int, blob binary", sent), "pieces")
    layout = dealt.filter("bucket < 0").select("chunk", F.col("n").alias("n_pieces"), F.col("blob").alias("layout"))
    groups = -(-chunks.count() // fan_in)
    pieces, found = dealt.filter("bucket >= 0").select("bucket", F.pmod(F.hash("chunk"), F.lit(max(1, groups))).alias("salt"), "n", "blob"), []
    for turn in itertools.count():
        done = work.save(settle(pieces, width, groups > 1), f"found_{turn}")
        found.append(done.filter("bits IS NOT NULL").select("chunk", "bucket", "bits"))
        if groups <= 1:
            break
        groups = -(-groups // fan_in)
        pieces = done.filter("blob IS NOT NULL").select("bucket", F.pmod("salt", F.lit(groups)).alias("salt"), "n", "blob")
    replies = found[0]
    for more in found[1:]:
        replies = replies.unionByName(more)
    answered = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))
    both = chunks.join(layout.join(answered, "chunk", "left").hint("shuffle_hash"), "chunk", "left")

    def cut(r: dict, c: Chunk):
        n, held = len(c.lengths), zstandard.ZstdDecompressor().decompress(r["layout"])
        copied = np.unpackbits(np.frombuffer(held[:n], np.uint8), count=n).astype(bool)
        answers: dict[int, list[bytes]] = defaultdict(list)
        for x in r["found"] or ():
            answers[x["bucket"]].append(x["bits"])
        covered = c.confirmed(np.frombuffer(held[n:], np.int64).reshape(6, r["n_pieces"]).T, answers)
        for i, (lo, hi, doc_id) in enumerate(zip(c.starts, c.ends, r["ids"])):
            data, gone = c.data[lo:hi], covered[lo:hi]
            if copied[i] and hi - lo >= width:
                gone = np.ones(hi - lo, bool)
            if characters:
                gone = whole_characters(data, gone)
            turns = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            kept = data[~gone].tobytes()
            spans = [[int(a), int(b - a)] for a, b in turns.reshape(-1, 2)]
            yield r["chunk"], i, doc_id, int(hi - lo), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text and characters else None

    return _on_chunks(both.select("chunk", "ids", "lengths", "data", "n_pieces", "layout", "found"), width, bits, buckets, KEPT, KEPT_DDL, cut)


def cut_repeats(df: DataFrame, width: int = WIDTH, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``df`` without repeated passages in their texts; ``chars_col``, where there is one,
    is counted anew, and the other columns stay as they are, whatever their types and names."""
    spark, work = df.sparkSession, Workspace(df.sparkSession, "repeats")
    bounded_batches(spark)
    row, chunk, place, kept = fresh(df.columns, "row", "chunk", "place", "kept")
    numbered = work.save(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows = numbered.select(F.col(row).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, homes = chunk_table(rows, work, total)
    places = chunks.select(F.col("chunk").alias(chunk), F.posexplode("ids").alias(place, row))
    beside = work.save(places.join(numbered.select(row, *(F.col(f"`{c}`") for c in df.columns if c != text_col)), row).drop(row), "beside")
    work.drop("rows")
    cut = _cut_chunks(chunks, work, width, total, True, True).select(F.col("chunk").alias(chunk), F.col("place").alias(place), F.col("kept").alias(kept))
    cut = work.save_dealt(cut, "cut", homes, chunk)
    work.keep("cut", "beside")
    value = {c: F.col(f"`{c}`") for c in df.columns} | {text_col: F.col(kept)}
    if chars_col in df.columns:
        value[chars_col] = F.length(kept).cast(df.schema[chars_col].dataType)
    # Texts lie in buckets by chunk: the other columns go there, and no text is moved.
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        result = work.save(cut.join(beside, [chunk, place]).select(*(value[c].alias(c) for c in df.columns)), "result")
    work.keep("result")
    return result


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
