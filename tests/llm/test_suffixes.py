"""Suffix dedup on long, periodic and binary-like texts, in one and several rounds."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from libgauge.llm import suffix_dedup


def slow(texts, width=200):
    """Per text: the bytes that lie in a string of width bytes which starts twice."""
    data = [(t or "").encode() for t in texts]
    marks = [np.fromiter((hash(b[k : k + width]) for k in range(len(b) - width + 1)), np.int64, max(0, len(b) - width + 1)) for b in data]
    values, counts = np.unique(np.concatenate(marks), return_counts=True)
    out = []
    for b, m in zip(data, marks):
        edge = np.zeros(len(b) + 1, np.int64)
        at = np.flatnonzero(counts[np.searchsorted(values, m)] > 1)
        edge[at] += 1
        edge[at + width] -= 1
        out.append(np.cumsum(edge[:-1]) > 0)
    return data, out


def check(got, texts):
    data, gone = slow(texts)
    rows = {r.doc_id: r for r in got}
    assert len(rows) == len(texts)
    for i, (b, g) in enumerate(zip(data, gone)):
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        spans = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    return sum(int(g.sum()) for g in gone)


def varied():
    """Edited copies, periods, zero characters, a passage in every text, strings of just under 200 bytes."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage, line, base = words(60), words(32)[:199], words(400)
    texts = []
    for k in range(120):
        w = base.split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        cut = rng.randrange(0, 200)
        texts.append(" ".join(w[cut:]) if k % 3 == 0 else words(rng.randrange(5, 300)) + passage + words(rng.randrange(0, 90)) + line + words(9))
    texts += ["ab" * 700, "ab" * 300 + "c" + "ab" * 90, "\0" * 500, "x" + "\0" * 230 + "y" + "\0" * 199 + "z", "a" * 9000, "é" * 130, "é" * 99 + "e", None, "", texts[3], texts[3] + "!"]
    return texts


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(varied())), "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 3000}, {"chunk_bytes": 3000, "fan_in": 2}, {"chunk_bytes": 1, "fan_in": 5}])
def test_rounds(spark, table, options):
    from pyspark.sql import functions as F

    got = suffix_dedup.dedup(table, **options).withColumn("n_spans", F.size("spans")).collect()
    assert check(got, varied()) > 20_000


def test_long_text(spark, tmp_path):
    """The registered query: a text of 4.5 MB, which also repeats inside itself and in short texts."""
    rng = random.Random(3)
    letters = "".join(chr(97 + b % 26) for b in rng.randbytes(4_500_000))
    long = letters[:4_200_000] + letters[2_090_000:2_105_000] + letters[4_200_000:]
    texts = [long, "z" + long[100_000:100_900] + "z", long[4_000_000:4_000_199], long[2_097_052:2_097_252], "tail " + long[-300:]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = suffix_dedup.op3_suffix_dedup(spark, str(tmp_path)).collect()
    assert check(got, texts) > 30_000


def test_no_table_is_left(spark, table):
    suffix_dedup.dedup(table)
    with pytest.raises(ValueError):
        suffix_dedup.dedup(table, width=60)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("libgauge_") and not t.isTemporary]
