"""Compression classifier: zstandard dictionaries of good and of bad text.

A text is cut into blocks of BLOCK bytes, and each is compressed with a dictionary trained on good
labelled texts and with one trained on bad ones: blocks are short, so that the dictionary and not the
text before decides their size.  The sum of the differences over the text's length is the one input of a
logistic calibration, which gives a score from 0 to 1.

Fitting is bounded whatever the size of the tables: at most FIT_ROWS labelled ids (those with the least
hash; if ids repeat in the documents, about that many of their rows), and for each dictionary at most
FIT_BYTES of pieces of FIT_PIECE bytes, chosen by hash from all over the whole texts.  Pieces are cut and
chosen by executors, so that only the chosen ones, and one difference for each text of the calibration
(every fourth), reach the driver.  Where zstandard finds too little text to train on, the pieces' own
bytes serve as the dictionary.  Scoring takes every whole text.

Defined results: null and empty texts are scored as the empty text; equal texts have equal scores;
without two labels of each class for either purpose every score is the share of good labels (0.5 if
there are none); unknown label values and labels without a document are left out; repeated labels count
repeatedly; an empty table gives an empty result; other columns are ignored, and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import Workspace, as_columns, bounded_batches, fresh, rows_out, texts

#: Bounds of the fit: labelled rows, and bytes of pieces for each dictionary.
FIT_ROWS, FIT_BYTES, FIT_PIECE = 20_000, 8 << 20, 512
BLOCK = 256
DICTIONARY_BYTES, LEVEL = 112_640, 3
THRESHOLD = 0.3
SCORE = "quality_score"
RIDGE = 1e-3


@dataclass(frozen=True)
class CompressionModel:
    """The two dictionaries (empty if nothing was learnt) and the calibration of their difference."""

    good: bytes
    bad: bytes
    base: float
    slope: float

    def score(self, payloads: list[bytes]) -> np.ndarray:
        x = differences(payloads, self.good, self.bad) if self.good else np.zeros(len(payloads))
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * x, -30, 30)))


@lru_cache(4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(payloads: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """For each text: how many bytes fewer it takes with the good dictionary, over its length."""
    a, b = _compressor(good).compress, _compressor(bad).compress
    total = [sum(len(b(t[i : i + BLOCK])) - len(a(t[i : i + BLOCK])) for i in range(0, len(t), BLOCK)) for t in payloads]
    return np.array(total, float) / np.array([len(t) + 16 for t in payloads], float)


def dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICTIONARY_BYTES].ljust(8, b"\n")


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x alone, by Newton's steps; RIDGE keeps separable labels finite."""
    scale = x.std() + 1e-9
    z = np.stack([np.ones(len(x)), x / scale], 1)
    w, ridge = np.zeros(2), np.array([0.0, RIDGE])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def id_crc(col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def choose_pieces(rows: DataFrame, total_bytes: int, fit_bytes: int) -> list[bytes]:
    """Pieces of whole texts (doc_id, text): those with the least hash, of fit_bytes at most."""
    most = max(1, fit_bytes // FIT_PIECE)
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((i, at, t[at : at + FIT_PIECE]) for b in batches for i, t in zip(b.column("doc_id").to_pylist(), texts(b, "text")) for at in range(0, len(t), FIT_PIECE))
        yield from rows_out(schema, pieces, size=lambda r: len(r[2]))

    mark = F.xxhash64("doc_id", "place", "piece")
    cut = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, place long, piece binary")
    part = 1.2 * most * FIT_PIECE / max(1, total_bytes)  # spares the sort what can hardly be among the least
    if part < 1:
        cut = cut.filter(mark < F.lit(int((part - 0.5) * 2.0**64)))
    return cut.orderBy(mark, "doc_id", "place").limit(most).toArrow().column("piece").to_pylist()


def fit_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> CompressionModel:
    """Learn from labels of rows whose id's crc32 is not divisible by 5."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "classifier")
    bounded_batches(spark)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (id_crc() % 5 != 0)).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)
    try:
        joined = docs.select(*as_columns(id_col, text_col)).join(F.broadcast(known), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
        rows = work.save(joined.withColumn("calibrates", id_crc() % 5 == 1), "labelled")
        if (n := rows.count()) > fit_rows:
            rows = rows.filter(F.pmod(F.xxhash64("doc_id", "label", "text"), F.lit(n)) < fit_rows)
        sums = {(r["calibrates"], r["label"]): (r["n"], r["bytes"]) for r in rows.groupBy("calibrates", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
        if any(sums.get((c, y), (0, 0))[0] < 2 for c in (True, False) for y in (0, 1)):
            count = [sum(n for (_, v), (n, _) in sums.items() if v == y) for y in (0, 1)]
            share = min(0.999, max(0.001, count[1] / sum(count))) if sum(count) else 0.5
            return CompressionModel(b"", b"", float(np.log(share / (1 - share))), 0.0)
        bad, good = (dictionary(choose_pieces(rows.filter(f"NOT calibrates AND label = {y}"), sums[False, y][1], fit_bytes)) for y in (0, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(differences(texts(b, "text"), good, bad), pa.float64())], names=["label", "x"])

        told = rows.filter("calibrates").select("label", "text").mapInArrow(run, "label int, x double").toArrow()
    finally:
        work.close()
    x, y = told.column("x").to_numpy(), told.column("label").to_numpy().astype(float)
    order = np.lexsort((y, x))  # sums don't depend on the order of tasks
    return CompressionModel(good, bad, *calibrate(x[order], y[order]))


def score_table(df: DataFrame, model: CompressionModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), score_col: str = SCORE) -> DataFrame:
    """The columns of ``keep`` and the score."""
    bounded_batches(df.sparkSession)
    (text,) = fresh([*keep, score_col], "text")
    rows = df.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text_col}`").cast("string").alias(text)) if text_col not in keep else df.select(*(F.col(f"`{k}`") for k in keep))
    source = text_col if text_col in keep else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array(model.score(texts(b, source)) if b.num_rows else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), scores], names=[*keep, score_col])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keep), T.StructField(score_col, T.DoubleType())]))


def keep_good(df: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose score reaches the threshold; all columns stay."""
    (score,) = fresh(df.columns, SCORE)
    return score_table(df, model, text_col, tuple(df.columns), score).filter(F.col(score) >= threshold).drop(score)


def op8_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_table(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_table(docs.select(*as_columns("doc_id", "text")), model)
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))
