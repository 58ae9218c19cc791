"""Whole programs on small folders, with stand-ins for models, the web, PDF and OCR libraries."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from libgauge.functions.text import similarity
from libgauge.operators import select
from libgauge.operators.number import number_rows
from libgauge.plans import benchmark, convert
from libgauge.sources import acquire, readers, seams, sinks

MODELS = json.dumps([{"name": "z", "model": "z", "api": "x"}, {"name": "a", "model": "a", "api": "x"}])


@pytest.fixture
def root(tmp_path):
    for d in ("protocols", "protocol_texts", "src"):
        (tmp_path / d).mkdir()
    for name, refs in (("p1", {"protocol_pdf": "src/p1.pdf"}), ("p2", {"protocol_pdf": "src/gone.pdf"}), ("p3", {"protocol_link": "https://e.org/3"}), ("p4", {})):
        (tmp_path / "protocols" / f"{name}.json").write_text(json.dumps({"protocol_id": name, "references": refs, "library_sequence": "ACGT", "segments": [{"name": "é", "type": "known", "sequence": "ACGT"}]}))
    (tmp_path / "src" / "p1.pdf").write_bytes(b"%PDF one")
    (tmp_path / "protocol_texts" / "p2.txt").write_text("text ü", encoding="utf-8")
    (tmp_path / "models.json").write_text(MODELS)
    return tmp_path


def told(r: seams.Request) -> str:
    """Answers with what the request would post."""
    body = seams.multipart(*seams.request_parts(r), "xx")
    return json.dumps({"result": {"library_sequence": "ACGT", "protocol_name": body.decode()}, "raw": 1})


def run(spark, root, mode, **options):
    result = benchmark.run_folder(spark, str(root / "models.json"), str(root), str(root / f"out-{mode}"), mode=mode, transport=told, **{"delay": 0.0, **options})
    return result, {(r.model_name, r.protocol_id): r for r in result.runs.collect()}


def test_bodies_by_mode(spark, root):
    _, pdf = run(spark, root, "pdf")
    assert 'name="file"; filename="p1.pdf"' in pdf["a", "p1"].prediction_protocol_name and "%PDF one" in pdf["a", "p1"].prediction_protocol_name and 'name="text"' not in pdf["a", "p1"].prediction_protocol_name
    assert {(k, r.error, r.source_used) for (m, k), r in pdf.items() if m == "a"} == {("p1", None, f"{root}/src/p1.pdf"), *((k, "missing protocol PDF", "") for k in ("p2", "p3", "p4"))}
    _, text = run(spark, root, "text")
    assert 'name="text"\r\n\r\ntext ü\r\n' in text["a", "p2"].prediction_protocol_name and text["a", "p2"].source_used == f"{root}/protocol_texts/p2.txt"
    assert text["a", "p1"].error == "missing protocol text"
    _, url = run(spark, root, "url")
    assert 'name="url"\r\n\r\nhttps://e.org/3\r\n' in url["a", "p3"].prediction_protocol_name and url["a", "p1"].error == "missing protocol URL"


def test_auto_and_envelope(spark, root):
    result, auto = run(spark, root, "auto", include_raw=True)
    assert {k: (r.source_used, r.error) for (m, k), r in auto.items() if m == "z"} == {"p1": (f"{root}/src/p1.pdf", None), "p2": (f"{root}/protocol_texts/p2.txt", None), "p3": ("https://e.org/3", None), "p4": ("", "no usable input source found")}
    (text,) = (p.read_text() for p in root.glob("out-auto/*.json"))
    whole = json.loads(text)
    assert [(r["model_name"], r["protocol_id"]) for r in whole["results"]] == [(m, p) for m in ("z", "a") for p in ("p1", "p2", "p3", "p4")]
    assert (whole["protocol_count"], whole["model_count"], whole["input_mode"]) == (4, 2, "auto") and whole["results"][0]["raw_output"] == 1
    assert text.isascii() and whole["region_results"][0]["segment_name"] == "é" and [r["segment_index"] for r in whole["region_results"]] == [0] * 6
    assert len(list(root.glob("out-auto/*"))) == 3 and result.files["runs"].startswith(f"{root}/out-auto/benchmark-runs-2")


def test_choice(spark, root):
    _, some = run(spark, root, "url", ids=[" p3 ", ""], limit=5)
    assert {k for _, k in some} == {"p3"}
    protocols = readers.load_protocols(spark, str(root))
    with pytest.raises(ValueError, match="zz"):
        select.choose(protocols, ["zz", "p1"])
    with pytest.raises(ValueError, match="No protocols selected"):
        select.choose(protocols, limit=0)
    assert [r.protocol_id for r in select.choose(protocols, limit=-3).collect()] == ["p1"] and [r.protocol_id for r in protocols.collect()] == ["p1", "p2", "p3", "p4"]
    with pytest.raises(FileNotFoundError, match="Protocol directory does not exist"):
        readers.load_protocols(spark, str(root), "nowhere")


def test_requests_go_out_once(spark, root):
    log = root / "log"

    def counting(r):
        with open(log, "a") as f:
            f.write("x")
        return told(r)

    result = benchmark.run(readers.models(spark, MODELS, inline=True), readers.load_protocols(spark, str(root)), counting, "url", delay=0.2)
    result.runs.collect(), result.by_model.collect(), result.regions.collect()
    assert len(log.read_text()) == 2  # p3, for two models


def test_pace(spark):
    rows = spark.createDataFrame([("m", "x", "u", None)] * 4, "model string, api string, source_used string, error string")
    began = datetime.now(UTC)
    seams.infer(rows, lambda r: "{}", delay=0.3).collect()
    assert 0.9 <= (datetime.now(UTC) - began).total_seconds()
    assert [r.duration_seconds for r in seams.infer(rows, lambda r: "{}").collect()] == [0.0] * 4


def test_pdf_to_text(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "b.pdf").write_bytes(b"one\n|  |two")
    (source / "a.pdf").write_bytes(b" ")
    (source / "note.txt").write_bytes(b"no")
    pages = lambda content: content.decode().split("|")
    rows = convert.pdf_to_text(spark, str(source), str(out), read=pages).collect()
    assert [r.message for r in rows] == ["  a.pdf → a.txt (0 chars, 0 lines)", "  b.pdf → b.txt (39 chars, 5 lines)"]
    assert (out / "b.txt").read_text() == "--- Page 1 ---\none\n\n\n--- Page 3 ---\ntwo" and (out / "a.txt").read_text() == ""
    assert len(convert.pdf_to_text(spark, str(source), str(out), file=str(source / "b.pdf"), read=pages).collect()) == 1
    for bad, kind in ((str(source / "c.pdf"), FileNotFoundError), (str(source / "note.txt"), ValueError)):
        with pytest.raises(kind):
            convert.pdf_to_text(spark, str(source), str(out), file=bad, read=pages)
    with pytest.raises(FileNotFoundError, match="No PDFs found"):
        convert.pdf_to_text(spark, str(out), str(out), read=pages)


def test_ocr_program(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir(), out.mkdir()
    for name, content in (("a", b" seen "), ("b", b"bad"), ("c", b"  "), ("d", b"old")):
        (source / f"{name}.pdf").write_bytes(content)
    (out / "d.txt").write_text("kept")

    def load():
        def recognise(content):
            if content == b"bad":
                raise ValueError("no text")
            return content.decode()

        return recognise

    rows = convert.run_ocr(spark, str(source), str(out), load)
    assert [(r.status, r.message) for r in rows.collect()] == [("converted", "a.pdf: wrote a.txt (4 chars)"), ("failed", "b.pdf: OCR failed (no text)"), ("converted", "c.pdf: wrote c.txt (0 chars)"), ("skipped", "d.pdf: d.txt already exists")]
    assert {p.name: p.read_text() for p in out.glob("*.txt")} == {"a.txt": "seen\n", "c.txt": "", "d.txt": "kept"}
    assert convert.summary(rows, "converted", "skipped", "failed") == ("Summary: converted=2 skipped=1 failed=1", 1)
    again = convert.run_ocr(spark, str(source), str(out), load, overwrite=True)
    assert (out / "d.txt").read_text() == "old\n" and convert.summary(again, "converted", "skipped", "failed")[0] == "Summary: converted=3 skipped=0 failed=1"


def test_download_program(spark, tmp_path):
    d, out = tmp_path / "protocols", tmp_path / "got"
    d.mkdir(), out.mkdir(), (tmp_path / "own").mkdir()
    links = {"a": {"protocol_link": "https://e.org/a"}, "b": {"protocol_link": "https://e.org/b", "protocol_pdf": "own/b.pdf"}, "c": {}, "d": {"protocol_link": "https://e.org/none"}, "e": {"protocol_link": 3}, "f": {"protocol_link": "https://e.org/f", "protocol_pdf": "own/f.html"}, "g": {"protocol_link": "https://e.org/g"}}
    for name, refs in links.items():
        (d / f"{name}.json").write_text(json.dumps({"protocol_id": name, "references": refs}))
    (out / "g.html").write_text("old")

    def get(url):
        if url.endswith("none"):
            raise OSError("refused")
        return b"%PDF " + url.encode(), "application/pdf", url

    rows = {r.protocol_id: (r.status, r.message) for r in convert.download(spark, str(d), str(out), get=get).collect()}
    assert {k: s for k, (s, _) in rows.items()} == {"a": "downloaded", "b": "downloaded", "c": "skipped", "d": "error", "e": "error", "f": "error", "g": "skipped"}
    assert (out / "a.pdf").read_bytes() == b"%PDF https://e.org/a" and (tmp_path / "own" / "b.pdf").exists() and "does not match" in rows["f"][1] and rows["d"][1] == "d: request failed for https://e.org/none (refused)"
    again = convert.download(spark, str(d), str(out), get=get)
    assert convert.summary(again, "downloaded", "skipped", "error") == ("Summary: downloaded=0 skipped=4 errors=3", 1)
    convert.download(spark, str(d), str(out), overwrite=True, get=get)
    assert sorted(p.name for p in out.iterdir()) == ["a.pdf", "g.pdf"]


def test_modules():
    assert seams.require_module("json", "x") is json
    with pytest.raises(RuntimeError, match="Missing dependency 'no_such_thing'. Install it with: pip install x"):
        seams.require_module("no_such_thing", "pip install x")


def test_stores(tmp_path):
    acquire.replace_file(f"file://{tmp_path}/x/y.bin", b"1")
    acquire.replace_file(f"{tmp_path}/x/y.bin", b"2")
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["y.bin"] and (tmp_path / "x" / "y.bin").read_bytes() == b"2"
    acquire.remove_file(f"{tmp_path}/x/y.bin"), acquire.remove_file(f"{tmp_path}/x/y.bin")


def test_formats(spark):
    rows = spark.createDataFrame([("2026-04-05 06:07:08.000090",), ("2026-04-05 06:07:08",)], "t string").select(F.to_timestamp("t").alias("t"))
    found = rows.select(sinks.stamp(F.col("t")).alias("s"), sinks.isoformat(F.col("t")).alias("i")).collect()
    assert [tuple(r) for r in found] == [("20260405T060708Z", "2026-04-05T06:07:08.000090+00:00"), ("20260405T060708Z", "2026-04-05T06:07:08+00:00")]
    texts = ["plain", "é 日本", "😀 a", "", "\u2028x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.j for r in df.select("k", sinks.ascii_json(F.to_json(F.struct("t"))).alias("j")).orderBy("k").collect()]
    assert [json.loads(j)["t"] for j in got] == texts and got[2] == '{"t":"\\ud83d\\ude00 a"}' and all(j.isascii() for j in got)
    assert sinks.start_lines(3, 2, "pdf", "m.json")[0] == "Starting benchmark: 2 models x 3 protocols = 6 runs"


def test_edit_distance_of_whole_texts(spark):
    """Spark's distance in characters against a slow one, whatever the script."""

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aé日😀\nß") for _ in range(rng.randrange(0, 25)))
    pairs = [(word(), word()) for _ in range(200)] + [("", ""), ("", "é"), ("😀", "😀")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("d"), similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        n = max(len(r.a), len(r.b))
        assert r.d == slow(r.a, r.b) and r.s == (1.0 if n == 0 else 1.0 - r.d / n)


def test_numbers(spark):
    rng = random.Random(7)
    values = [(rng.randrange(1000), k) for k in range(5000)]
    df = spark.createDataFrame(values, "v int, k int").repartition(7)
    got = {r.k: r.n for r in number_rows(df, "n", "v", "k").collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted(values), 1)}
    assert number_rows(df.limit(0), "n", "v").count() == 0
