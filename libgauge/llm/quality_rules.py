"""Quality rules: hard limits on document statistics, then gradient-boosted trees over them.

Trees are grown on the driver from at most FIT_ROWS labelled rows and flattened into numpy node
arrays; a batch of documents goes down all trees at once, level by level.  On the features named in
MONOTONE the score may only fall (or rise) with the feature: splits that break this are not made,
and the values below a split are bounded by the middle between its two sides.

Words are runs of bytes other than ASCII white space.  Statistics cover whole texts.

Defined results: a null or empty text has no words and fails the base rules; equal texts have equal
results; without labels of both classes no tree is grown and the base rules decide alone; labels
without a document are left out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import as_columns, bounded_batches, rows_out, texts

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = b"#*$%&|<>"
#: At most so many labelled rows, those with the least hash of their id, are used to fit.
FIT_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "stop_ratio", "same_next_ratio")
#: -1: the score may only fall as the feature rises.
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "upper_ratio": -1, "same_next_ratio": -1}


def _repeat_words(ids: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur at least twice."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ (ids[k : k + n].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0
    rank = ids.astype(np.int64)  # some hashes agree: rank the windows exactly, by doubling
    for width in (1, 2, 4):
        m = len(rank) - width
        rank = np.unique(rank[:m] * (rank.max() + 1) + rank[width:], return_inverse=True)[1].reshape(-1)
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of COUNTS and the features of FEATURES of a whole text."""
    words = text.split()
    n = len(words)
    if n == 0:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0), (0.0,) * len(FEATURES)
    joined = b"".join(words)
    raw = np.frombuffer(joined, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    symbols = sum(map(joined.count, (bytes((c,)) for c in SYMBOLS)))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    doubled = len(lines) - len(set(lines))
    repeats = _repeat_words(ids)
    occurs = np.bincount(ids)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    features = (
        float(np.log1p(n)), chars / n, symbols / chars, doubled / max(1, len(lines)), repeats / n, len(numbers) / n,
        upper / chars, digits / chars, float(occurs.max()) / n, float((ids[1:] == ids[:-1]).sum()) / n,
    )
    return (n, chars, symbols, doubled, repeats), features


@dataclass(frozen=True)
class Trees:
    """Node arrays of all trees one after the other; ``feature`` is -1 in leaves."""

    base: float = 0.0
    cut: float = 0.0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            while (inner := self.feature[at] >= 0).any():
                f = np.where(inner, self.feature[at], 0)
                down = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            total += self.value[at].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 3.0, lost: float = 0.002) -> Trees:
    """Boost log-loss trees on binned features.  ``cut``: at most the share ``lost`` of good rows scores below it, and never more than 0.5."""
    if len(y) == 0 or y.min() == y.max():
        return Trees(base=0.0, cut=0.0)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    sign = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)  # v <= cuts[k] exactly where code <= k
    nodes: list[list] = []
    roots, total = [], np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        own = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), low, high))
        nodes.append([-1, 0.0, -1, -1, rate * value])
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f in range(x.shape[1]) if level < depth and hs >= 2 * least else ():
            m = len(cuts[f])
            if m == 0:
                continue
            gl = np.cumsum(np.bincount(codes[rows, f], g[rows], m + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[rows, f], h[rows], m + 1))[:-1]
            a, b = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
            part = lambda g, h, v: -(g * v + 0.5 * (h + ridge) * v * v)
            gain = part(gl, hl, a) + part(gs - gl, hs - hl, b) - part(gs, hs, value)
            gain[(hl < least) | (hs - hl < least) | (sign[f] * (b - a) < 0)] = 0
            if gain[k := int(gain.argmax())] > best[0]:
                best = (float(gain[k]), f, k, float(a[k]), float(b[k]))
        _, f, k, a, b = best
        if f >= 0:
            mid = (a + b) / 2
            sides = ((low, high), (low, high)) if sign[f] == 0 else ((mid, high), (low, mid)) if sign[f] < 0 else ((low, mid), (mid, high))
            below = codes[rows, f] <= k
            left = grow(rows[below], g, h, level + 1, *sides[0])
            right = grow(rows[~below], g, h, level + 1, *sides[1])
            nodes[own][:4] = [f, float(cuts[f][k]), left, right]
        return own

    every = np.arange(len(y))
    arrays = Trees(base=base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        first = len(nodes)
        roots.append(grow(every, p - y, p * (1 - p), 0, -np.inf, np.inf))
        kind, thr, left, right, value = (np.array(c) for c in zip(*nodes[first:]))
        one = Trees(0.0, 0.0, np.zeros(1, np.int32), kind.astype(np.int32), thr, left.astype(np.int32) - first, right.astype(np.int32) - first, value)
        p1 = one.score(x)
        total += np.log(p1 / (1 - p1))
    columns = [np.array(c) for c in zip(*nodes)]
    arrays = Trees(base, 0.0, np.array(roots, np.int32), columns[0].astype(np.int32), columns[1], columns[2].astype(np.int32), columns[3].astype(np.int32), columns[4])
    cut = min(0.5, float(np.quantile(arrays.score(x)[y == 1], lost)))
    return Trees(arrays.base, cut, arrays.roots, arrays.feature, arrays.threshold, arrays.left, arrays.right, arrays.value)


STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
STAT_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])


def fit_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    """Trees from a bounded sample of labelled rows; ids whose crc32 is divisible by 5 are held out."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)
    bounded_batches(docs.sparkSession)
    rows = docs.select(*as_columns(id_col, text_col)).join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])
        yield from rows_out(schema, ((i, y, list(statistics(t)[1])) for b in batches for i, y, t in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), texts(b, "text"))))

    found = rows.mapInArrow(run, "doc_id long, label int, x array<double>")
    table = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(fit_rows).toArrow()  # ids may repeat in the documents
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(table.column("label").to_pylist(), float))


def apply_rules(df: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, score for every row."""
    bounded_batches(df.sparkSession)
    schema = pa.schema([*STAT_SCHEMA, ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in texts(b, "text")]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            score = model.score(np.array([f for _, f in found], float).reshape(-1, len(FEATURES)))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, counts.T), pa.array(failed), pa.array(~failed & (score >= model.cut)), pa.array(score)], schema=schema)

    return df.select(*as_columns(id_col, text_col)).mapInArrow(run, STATS + ", base_failed boolean, kept boolean, score double")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_rules(docs, fit_table(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
