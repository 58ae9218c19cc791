"""Packing documents into sequences by bounded-space online best-fit.

A document's ids and END_ID are one piece if they fit into a sequence; longer ones are cut from the
end into pieces of full length, so that only the first piece may be shorter.  Pieces are dealt by a
hash to tasks of about PACK_ROWS.  A task takes them in the order of that hash, reads AHEAD at a time
and places those the longest first: a piece goes to the open bin whose free space is the least that
holds it, found in a bitset keyed by free space.  At most OPEN_BINS bins are open; when one more is
needed, the fullest closes.

Only ids' lengths and checksums are dealt out, never texts.  Packing is a function of the pieces, so
a task that is run again gives the same sequences.

Defined results: a null or empty text is the one id END_ID; repeated rows are packed each on its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, as_columns, bounded_batches, rows_out
from .tokens import encoder

LENGTH = 1024
END_ID = 2
#: Bins open at a time, and pieces read before the longest of them is placed.
OPEN_BINS, AHEAD = 256, 512
PACK_ROWS = 1 << 17


def cut(total: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    head = total if total <= length else total % length
    pieces = [(0, head)] if head else []
    return pieces + [(at, length) for at in range(head, total, length)]


class BestFit:
    """Open bins by free space; ``place`` gives (bin, offset)."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.limit = length, open_bins
        self.bits = self.open = self.made = 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        bin_id = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_id, self.made = self.length, self.made, self.made + 1
        left = free - size
        if left:
            self.bins[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.length - free


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(df: DataFrame, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """The pieces of every document."""
    bounded_batches(df.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, json_path).ids

        def rows():
            for b in batches:
                for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    ids = encode(text or "") + end
                    for k, (start, n) in enumerate(cut(len(ids) // 4, length)):
                        yield i, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])

        yield from rows_out(PIECES, rows())

    return df.select(*as_columns(id_col, text_col)).mapInArrow(run, PIECE_DDL)


def pack_pieces(pieces: DataFrame, tasks: int, length: int = LENGTH, open_bins: int = OPEN_BINS, ahead: int = AHEAD) -> DataFrame:
    """Pieces with sequence_id and offset."""
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = BestFit(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, ahead):
                b = batch.slice(at, ahead)
                sizes = b.column("length").to_pylist()
                placed: list = [None] * len(sizes)
                for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):  # noqa: B023
                    placed[k] = packer.place(sizes[k])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + k for k, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], schema=schema)

    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartition(tasks, order).sortWithinPartitions(order, "doc_id", "piece", "ids_crc32", "length")
    return dealt.mapInArrow(run, PIECE_DDL + ", sequence_id long, offset long")


def pack(df: DataFrame, length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS, pack_rows: int = PACK_ROWS, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    work = Workspace(df.sparkSession, "packing")
    pieces = work.save(cut_documents(df, length, end_id, **columns), "pieces")
    return pack_pieces(pieces, max(1, round(pieces.count() / pack_rows)), length, open_bins)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
