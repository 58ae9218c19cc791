"""The compression classifier's query against a slow version."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import zstandard

from libgauge.llm import quality_classifier as qc


def tables(spark, folder, n=240):
    rng = random.Random(4)
    good = lambda: " ".join(f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.randrange(20, 300)))
    bad = lambda: " ".join(rng.choice(["click here", "buy now", "$$$", f"x{rng.randrange(900)}"]) for _ in range(rng.randrange(20, 300)))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(n)]
    extra = [(n, None), (n + 1, ""), (n + 2, rows[1][1]), (1, rows[1][1]), (n + 3, rows[0][1] * 300), (None, "w1 w2")]
    spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(5, 1, 0), (7, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, [r[:2] for r in rows] + extra


def slow_difference(text, model):
    data, out = (text or "").encode(), 0
    for k in range(0, len(data), 256):
        for sign, d in ((1, model.bad), (-1, model.good)):
            out += sign * len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[k : k + 256]))
    return out / (len(data) + 16)


def test_query(spark, tmp_path):
    rows, docs = tables(spark, tmp_path)
    model = qc.fit_table(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    truth = {i: y for i, _, y in rows}
    got = qc.op8_compression_classifier(spark, str(tmp_path)).collect()
    texts = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), texts):
        z = model.base + model.slope * slow_difference(t, model)
        assert r.doc_id == i and abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, y in held if y == v] for v in (1, 0))
    assert len(bad) > 5 and sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_calibration():
    """No weights near those found have a lower penalised loss."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.02, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 80 * x)))).astype(float)
    base, slope = qc.calibrate(x, y)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a + b * x)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + qc.RIDGE / 2 * (b * x.std()) ** 2

    assert all(loss(base, slope) <= loss(base + da, slope + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-1, 0, 1))


def test_bounds(spark, tmp_path):
    """Pieces are those with the least hash, whole texts give them, and no more than the bound comes."""
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "".join(rng.choice("abcdef ") for _ in range(3000))) for i in range(50)], "doc_id long, text string")
    every = qc.choose_pieces(df, 150_000, 1 << 20)
    some = qc.choose_pieces(df, 150_000, 30_000)
    assert len(every) == 50 * 6 and len(some) == 30_000 // qc.FIT_PIECE and set(some) <= set(every) and len({len(p) for p in every}) == 2
    assert qc.fit_table(df, spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int"), fit_rows=30).good
