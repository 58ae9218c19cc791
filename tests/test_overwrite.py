"""Downloads that replace a file of another name."""

from __future__ import annotations

from libgauge.sources import acquire, seams


def test_overwrite_removes_the_old_file(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    for name in ("a.html", "b.pdf", "x.html"):
        (folder / name).write_bytes(b"old")
    plan = spark.createDataFrame([("a", "https://e.org/a", None), ("b", "https://e.org/b", None), ("c", "https://e.org/c", "src/c.txt")], "protocol_id string, url string, target_path string")
    files = spark.createDataFrame([(str(p),) for p in folder.iterdir()], "path string")
    waiting = acquire.pending(acquire.plan_targets(plan, files, str(tmp_path), str(folder)), overwrite=True).filter("status IS NULL")
    got = seams.fetch(waiting.select("protocol_id", "url", "target_path", "existing"), lambda url: (b"%PDF", "application/pdf", url))
    final = acquire.final_targets(got, str(tmp_path), str(folder))
    assert acquire.store(final).count() == 3 and (folder / "a.html").exists()
    done = {r.protocol_id: r.status for r in acquire.store(final, overwrite=True).collect()}
    assert done == {"a": "downloaded", "b": "downloaded", "c": "error"}
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {"a.pdf": b"%PDF", "b.pdf": b"%PDF", "x.html": b"old"}
