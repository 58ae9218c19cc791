"""Requests against a local server, journals, killed tasks, OCR by page, and files written twice at once."""

from __future__ import annotations

import csv
import io
import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from libgauge.functions.segments import same_value
from libgauge.operators.score import score_runs
from libgauge.plans import benchmark
from libgauge.sources import files, readers, seams, sinks
from libgauge.store import close_all

TRUTH = {"references": {"protocol_pdf": "src/p.pdf", "protocol_link": "https://e.org/p"}, "library_sequence": "ACGT", "segments": [{"name": "n", "type": "known", "sequence": "ACGT"}]}


class Server(ThreadingHTTPServer):
    """Echoes what it is posted; paths ask for errors."""

    daemon_threads = True

    def __init__(self):
        self.bodies = []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers["Content-Length"]))
                outer.bodies.append((self.path, self.headers["Content-Type"], body))
                code, reply = {"/broken": (503, b"try \xff later"), "/text": (200, b"no JSON"), "/list": (200, b"[1]")}.get(self.path, (200, json.dumps({"result": {"library_sequence": "ACGT", "protocol_name": body.decode()}}).encode()))
                self.send_response(code)
                self.send_header("Content-Length", str(len(reply)))
                self.end_headers()
                self.wfile.write(reply)

            def log_message(self, *args):
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server_port}"


@pytest.fixture(scope="module")
def server():
    s = Server()
    yield s
    s.shutdown()


@pytest.fixture
def root(tmp_path):
    for d in ("protocols", "protocol_texts", "src"):
        (tmp_path / d).mkdir()
    (tmp_path / "protocols" / "p.json").write_text(json.dumps(TRUTH))
    (tmp_path / "src" / "p.pdf").write_bytes(b"%PDF one")
    (tmp_path / "protocol_texts" / "p.txt").write_text("text ü", encoding="utf-8")
    return tmp_path


def test_every_mode_and_error(spark, server, root):
    models = [{"name": n, "model": n, "api": server.url + path} for n, path in (("good", "/ok"), ("gone", "/broken"), ("words", "/text"), ("list", "/list"))] + [{"name": "down", "model": "down", "api": "http://127.0.0.1:9/x"}]
    (root / "models.json").write_text(json.dumps(models))
    for mode, part in (("pdf", b'name="file"; filename="p.pdf"\r\nContent-Type: application/pdf\r\n\r\n%PDF one\r\n'), ("text", b'name="text"\r\n\r\ntext \xc3\xbc\r\n'), ("url", b'name="url"\r\n\r\nhttps://e.org/p\r\n')):
        server.bodies.clear()
        result = benchmark.run_folder(spark, str(root / "models.json"), str(root), str(root / f"out-{mode}"), mode=mode, delay=0.0, timeout=20.0)
        errors = {r.model_name: r.error for r in result.runs.collect()}
        assert errors["good"] is None and errors["gone"] == "HTTP 503: try � later" and errors["down"].startswith("Request failed: ")
        assert errors["words"] == "Invalid JSON from benchmark API" and errors["list"] == "Benchmark API returned a non-object JSON response"
        assert Counter(p for p, *_ in server.bodies) == {"/ok": 1, "/broken": 1, "/text": 1, "/list": 1}
        assert all(part in body and b'name="model"\r\n\r\n' in body and kind.startswith("multipart/form-data; boundary=") for _, kind, body in server.bodies)
        assert result.seen == {"runs": 5, "failures": 4}
        result.close()


def test_default_pace():
    import inspect

    assert inspect.signature(benchmark.run_folder).parameters["delay"].default == 1.0


def test_pace_of_several_tasks(spark, root):
    """One request goes out a delay, whatever the number of tasks."""
    import time

    log = str(root / "log")
    rows = spark.createDataFrame([("m", "x", f"u{k}", None) for k in range(9)], "model string, api string, source_used string, error string")

    def timed(r):
        with open(log, "a") as f:
            f.write(f"{os.getpid()} {time.time()}\n")
        return r.source

    assert seams.infer(rows, timed, delay=0.3, requests_at_once=3).filter("error IS NULL").count() == 9
    at = sorted(float(line.split()[1]) for line in open(log))
    assert len(at) == 9 and at[-1] - at[0] > 0.3 * 3 * 2 - 0.2  # the busiest of three tasks pauses at least twice, for three delays


def test_a_run_that_died_goes_on(spark, root):
    """The worker dies after some replies; the next run only sends what has none."""
    log, lives = str(root / "log"), str(root / "lives")
    open(lives, "w").close()
    names = [f"p{k}" for k in range(12)]
    protocols = spark.createDataFrame([(f"{n}.json", n, n, None, f"https://e.org/{n}", None, "ACGT", None, "{}") for n in names], f"file_name string, protocol_id string, protocol_name string, pdf_path string, protocol_url string, text_path string, library_sequence string, segments array<{seams_segment()}>, placeholders string")
    models = readers.models(spark, '[{"name": "m", "model": "m", "api": "x"}]', inline=True)

    def fragile(r):
        with open(log, "a") as f:
            f.write(r.source + "\n")
        if os.path.exists(lives) and len(open(log).read().split()) > 5:
            os.remove(lives)
            os._exit(1)  # as a lost executor would
        return json.dumps({"result": {"library_sequence": "ACGT"}})

    with pytest.raises(Exception):  # noqa: B017
        benchmark.run(models, protocols, fragile, "url", requests_at_once=1, journal=str(root / "journal"))
    told = [f for f in os.listdir(root / "journal") if f.endswith(".json")]
    assert len(told) == 5
    result = benchmark.run(models, protocols, fragile, "url", requests_at_once=1, journal=str(root / "journal"))
    assert result.seen == {"runs": 12, "failures": 0}
    sent = Counter(open(log).read().split())
    assert len(sent) == 12 and sum(sent.values()) == 13  # the one that was under way when the worker died
    again = benchmark.run(models, protocols, fragile, "url", journal=str(root / "journal"))
    assert again.seen["runs"] == 12 and sum(Counter(open(log).read().split()).values()) == 13
    close_all()


def test_a_task_that_runs_again_asks_nothing_twice(spark, root):
    rows = spark.createDataFrame([("m", "x", f"u{k}", None) for k in range(9)], "model string, api string, source_used string, error string")
    log = str(root / "log")

    def counting(r):
        with open(log, "a") as f:
            f.write("x")
        return r.source

    asked = seams.infer(rows, counting, journal=str(root / "journal"))
    for _ in range(3):
        assert sorted(r.response for r in asked.collect()) == [f"u{k}" for k in range(9)]
    assert len(open(log).read()) == 9


def test_replies_keep_other_columns(spark):
    rows = spark.createDataFrame([(9007199254740993, "m", "x", "u", None, "r", "f"), (None, "m", "x", "v", "", "r", "f"), (1, "m", "x", "w", "before", "r", "f")], "big long, model string, api string, source_used string, error string, reply string, failure string")
    got = {r.source_used or r.error: r for r in seams.infer(rows, lambda r: r.source).collect()}
    assert got["u"].big == 9007199254740993 and got["u"].response == "u" and (got["v"].big, got["v"].error, got["v"].reply) == (None, "", "r")
    assert got["before"].response is None and got["before"].duration_seconds == 0.0


def seams_segment():
    from libgauge.functions.segments import SEGMENT

    return SEGMENT


def test_contents_are_not_multiplied(spark, root):
    """The plan of the requests has no content until the join with the files, which moves each file once."""
    protocols = readers.load_protocols(spark, str(root))
    contents = (readers.read_binaries(spark, str(root), recursive=True), readers.read_texts(spark, str(root / "protocol_texts")))
    models = readers.models(spark, json.dumps([{"name": f"m{k}", "model": "m", "api": "x"} for k in range(3)]), inline=True)
    planned = benchmark.plan_runs(models, readers.with_presence(protocols, *contents), "pdf")
    assert not {"content", "pdf_content"} & set(planned.columns) and planned.filter("error IS NULL").count() == 3
    sizes = [r.response for r in seams.infer(planned, lambda r: f"{len(r.content)} {r.kind}", contents=contents).collect()]
    assert sizes == ["8 pdf"] * 3


def test_one_document_uses_all_tasks(spark):
    docs = spark.createDataFrame([("long", bytearray(b"|".join(b"page %d" % k for k in range(1000)))), ("bad", bytearray(b"a|fault|b")), ("none", bytearray(b"")), ("torn", bytearray(b"torn"))], "path string, content binary")

    def split(content):
        if content == b"torn":
            raise ValueError("no pages")
        return content.split(b"|") if content else []

    def load():
        from pyspark import TaskContext

        def recognise(image):
            if image == b"fault":
                raise ValueError("no text")
            return f"{image.decode()} {TaskContext.get().partitionId()} {os.getpid()} {id(recognise)}"

        return recognise

    got = {r.path: r for r in seams.ocr(docs, load, split, tasks=8).collect()}
    pages = got["long"].text.split("\n\n\n\n")
    assert [p.rsplit(" ", 3)[0] for p in pages] == [f"page {k}" for k in range(1000)]
    assert {p.split()[2] for p in pages} == set(map(str, range(8)))
    models = {tuple(p.split()[3:]) for p in pages}
    assert len(models) == len({m[0] for m in models})  # one recogniser for each worker process
    assert (got["bad"].text, got["bad"].error, got["none"].text, got["none"].error, got["torn"].error) == (None, "no text", "", None, "no pages")


def test_two_attempts_at_once(tmp_path):
    target, sizes = f"{tmp_path}/d/x.bin", [1 << 20, 3 << 20]
    contents = [bytes([65 + k]) * n for k, n in enumerate(sizes)]
    start = threading.Barrier(len(contents))

    def attempt(content):
        for _ in range(20):
            start.wait()
            files.replace_file(target, content)

    threads = [threading.Thread(target=attempt, args=(c,)) for c in contents]
    [t.start() for t in threads], [t.join() for t in threads]
    assert files.read_file(target) in contents and os.listdir(tmp_path / "d") == ["x.bin"]


def test_a_failed_attempt_leaves_nothing(tmp_path):
    with pytest.raises(TypeError):
        files.replace_file(f"{tmp_path}/d/x.bin", "not bytes")
    assert os.listdir(tmp_path / "d") == [] and files.read_file(f"{tmp_path}/d/x.bin") is None


def test_csv_bytes(spark, tmp_path):
    rng_rows = [(f"p{k}", "a,b" if k % 3 else 'say "x"\nand \r', None if k % 4 == 0 else k * 1e-5, k % 2 == 0, float(10 ** (k % 20)), k / 7) for k in range(300)]
    rows = spark.createDataFrame(rng_rows, "protocol_id string, protocol_name string, duration_seconds double, library_exact boolean, library_similarity double, ordered_region_accuracy double").repartition(6)
    assert sinks.write_csv(rows, sinks.RUN_COLUMNS, f"{tmp_path}/runs.csv", ("protocol_id",))
    want = io.StringIO(newline="")
    out = csv.DictWriter(want, fieldnames=sinks.RUN_COLUMNS)
    out.writeheader()
    for r in sorted(rng_rows):
        row = dict(zip(("protocol_id", "protocol_name", "duration_seconds", "library_exact", "library_similarity", "ordered_region_accuracy"), r))
        out.writerow({c: row.get(c, "") for c in sinks.RUN_COLUMNS})
    assert (tmp_path / "runs.csv").read_bytes() == want.getvalue().encode()
    assert not sinks.write_csv(rows.limit(0), sinks.RUN_COLUMNS, f"{tmp_path}/none.csv") and [p.name for p in tmp_path.iterdir()] == ["runs.csv"]
    with pytest.raises(FileExistsError):
        sinks.write_csv(rows, sinks.RUN_COLUMNS, f"{tmp_path}/runs.csv")
    assert sinks.write_csv(rows.limit(1), sinks.RUN_COLUMNS, f"{tmp_path}/runs.csv", mode="overwrite") and len((tmp_path / "runs.csv").read_bytes().splitlines()) in (2, 3, 4)


def test_document_bytes(spark, root):
    """The JSON document as json.dump writes it with indent=2, and no distance in its plan."""
    (root / "models.json").write_text(json.dumps([{"name": n, "model": n, "api": "x"} for n in "ab"]))

    def told(r):
        if r.model == "b":
            raise RuntimeError("Request failed: é")
        return json.dumps({"result": {"library_sequence": "ACG", "segments": [{"sequence": "ACé"}], "more": {"x": [1, {"y": []}], "z": {}}}})

    result = benchmark.run_folder(spark, str(root / "models.json"), str(root), str(root / "out"), mode="text", delay=0.0, transport=told)
    text = (root / "out" / os.path.basename(result.files["json"])).read_text()
    whole = json.loads(text)
    assert text == json.dumps(whole, indent=2) + "\n" and list(whole["results"][0]) == [f for f in sinks.RUN_FIELDS if f != "raw_output"]
    assert "prediction" not in whole["results"][1] and whole["results"][0]["prediction"]["more"] == {"x": [1, {"y": []}], "z": {}} and list(whole["region_results"][0]) == list(sinks.REGION_FIELDS)
    plan = sinks.envelope(result.runs, result.regions, result.by_model, result.by_model_and_region, (1, 2), "a", "b", "text", "m")._jdf.queryExecution().toString()
    assert "levenshtein" not in plan and "_far" not in plan
    empty = sinks.envelope(*(t.limit(0) for t in (result.runs, result.regions, result.by_model, result.by_model_and_region)), (0, 0), "a", "b", "text", "m")
    text = "\n".join(r.value for r in empty.collect())
    assert text == json.dumps(json.loads(text), indent=2)
    result.close()


VALUES = [("1", "1e0"), ("1", "1.0"), ("1", "true"), ("0", "false"), ("-0", "0.0"), ("1.50", "15e-1"), ("9007199254740993", "9007199254740992.0"), ("9007199254740992", "9007199254740992.0"), ('"1"', "1"), ('"true"', "1"), ("null", "false"), ("1e20", "100000000000000000000"), ("0.1", "0.10000000000000001"), ("0.1", "0.11"), ('"a\\"1"', '"a\\"1.0"'), ("[1, true]", "[true, 1.0]"), ('{"b": 1, "a": [2]}', '{"a": [2.0], "b": true}'), ("[]", "{}"), ('"é 1.0"', '"\\u00e9 1.0"')]


def test_maps_are_equal_by_value(spark):
    rows = spark.createDataFrame([(k, f'{{"k": {a}}}', f'{{"k": {b}}}') for k, (a, b) in enumerate(VALUES)], "k int, a string, b string")
    shown = lambda c: F.to_json(F.parse_json(c))
    got = [r.same for r in rows.select("k", same_value(shown(F.col("a")), shown(F.col("b"))).alias("same")).orderBy("k").collect()]
    assert got == [json.loads(a) == json.loads(b) for a, b in VALUES]
    none = F.array().cast(f"array<{seams_segment()}>")
    scored = score_runs(readers.predictions(rows.select("k", shown(F.col("a")).alias("gt_placeholders"), F.concat(F.lit('{"result": {"placeholder_key": '), "b", F.lit("}}")).alias("response"), F.lit("").alias("gt_library"), none.alias("gt_segments"))))
    assert [r.placeholder_key_exact for r in scored.orderBy("k").collect()] == got


def test_hidden_files_are_listed(spark, root):
    for name in (".a.json", "_b c.json", "%2e.json", "c d+e.json"):
        (root / "protocols" / name).write_text(json.dumps({**TRUTH, "protocol_id": name}))
    (root / "protocols" / ".note").write_text("no")
    (root / "protocols" / ".dir.json").mkdir()
    (root / "protocol_texts" / ".a.txt").write_text("hidden text")
    rows = {r.file_name: r for r in readers.load_protocols(spark, str(root)).collect()}
    assert set(rows) == {"p.json", ".a.json", "_b c.json", "%2e.json", "c d+e.json"} and rows["_b c.json"].protocol_id == "_b c.json"
    texts = {r.file_name: (r.path, r.value) for r in readers.read_texts(spark, str(root / "protocol_texts")).collect()}
    assert texts["p.txt"][0] == f"{root}/protocol_texts/p.txt"
    assert texts[".a.txt"] == (f"{root}/protocol_texts/.a.txt", "hidden text") and len(texts) == 2
    close_all()
