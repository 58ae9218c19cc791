"""Targets, skips and stored downloads, without a network."""

from __future__ import annotations

from pyspark.sql import functions as F

from libgauge.operators.aggregate import status_counts
from libgauge.sources import acquire, seams


def get(url):
    return b"%PDF", "application/pdf", url


def test_downloads(spark, tmp_path):
    plan = spark.createDataFrame([("a 1", "https://e.org/a", None), ("b", None, None), ("c", "https://e.org/c", "src/c.txt"), ("d", "https://e.org/d", None), ("e", "https://e.org/e", "src/E.PDF")], "protocol_id string, url string, target_path string")
    folder = str(tmp_path / "src")
    files = spark.createDataFrame([(f"{folder}/d.zip",), (f"{folder}/d.pdf",), (f"{folder}/x.pdf",)], "path string")
    aimed = acquire.plan_targets(plan, files, str(tmp_path), folder)
    assert {r.protocol_id: (r.target, r.target_exists) for r in aimed.collect()} == {"a 1": (f"{folder}/a-1", False), "b": (f"{folder}/b", False), "c": (f"{tmp_path}/src/c.txt", False), "d": (f"{folder}/d.pdf", True), "e": (f"{tmp_path}/src/E.PDF", False)}
    waiting = acquire.pending(aimed)
    assert {r.protocol_id for r in waiting.filter("status = 'skipped'").collect()} == {"b", "d"}
    assert {r.protocol_id for r in acquire.pending(aimed, overwrite=True).filter("status = 'skipped'").collect()} == {"b"}
    got = seams.fetch(waiting.filter("status IS NULL").select("protocol_id", "url", "target_path"), get)
    done = acquire.store(acquire.final_targets(got, str(tmp_path), folder)).cache()
    assert {r.protocol_id: r.status for r in done.collect()} == {"a 1": "downloaded", "c": "error", "e": "downloaded"}
    assert (tmp_path / "src" / "a-1.pdf").read_bytes() == b"%PDF" and (tmp_path / "src" / "E.PDF").exists() and not list((tmp_path / "src").glob("*.part"))
    assert {r.status: r.n for r in status_counts(done).collect()} == {"downloaded": 2, "error": 1}
    assert acquire.exit_code(done) == 1 and acquire.exit_code(done.filter(F.col("status") != "error")) == 0
