"""The invented golden run, from JSON files to summaries, sinks and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from libgauge.operators import aggregate, score, select
from libgauge.plans import benchmark
from libgauge.sources import readers, seams, sinks
from libgauge.streaming.scorer import score_available

SEGMENTS = [
    {"name": "p5", "type": "known", "sequence": "ACGT", "length": 4},
    {"name": "cb", "type": "barcode", "char": "B", "sequence": "BBBB", "length": 4},
    {"name": "umi", "type": "umi", "char": "U", "sequence": "UUU", "length": 3},
    {"name": "p7", "type": "known", "sequence": "GGCA", "length": 4},
]
TRUTH = {"protocol_id": "demo-a", "protocol_name": "Demo A", "references": {"protocol_pdf": "src/demo-a.pdf", "protocol_link": "https://e.org/a.pdf"}, "library_sequence": "ACGTBBBBUUUGGCA", "segments": SEGMENTS, "placeholder_key": {"B": "cell", "U": "umi"}}
MODELS = json.dumps({"models": [{"name": "m1", "model": "v/m1", "api": "x"}, {"id": "m2", "api": "x"}, {"model": "m3", "api": "x"}]})


def answer(r: seams.Request) -> str:
    if r.model == "m3":
        raise RuntimeError("Request failed: refused")
    kept = SEGMENTS if r.model == "v/m1" else [SEGMENTS[0], SEGMENTS[1], SEGMENTS[3]]
    return json.dumps({"result": {"library_sequence": "".join(s["sequence"] for s in kept), "segments": kept, "placeholder_key": {"U": "umi", "B": "cell"}, "protocol_name": "Demo"}})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("assays")
    (d / "demo-a.json").write_text(json.dumps(TRUTH))
    (d / "list.json").write_text("[1]")
    (d / "demo-a.txt").write_text("oligo ACGT")
    return str(d)


@pytest.fixture(scope="module")
def protocols(spark, folder):
    return readers.protocols(readers.read_json_files(spark, folder), readers.read_texts(spark, folder), "/root-dir")


@pytest.fixture(scope="module")
def result(spark, protocols):
    return benchmark.run(readers.models(spark, MODELS, inline=True), protocols, answer, "text")


def test_protocols(protocols, folder):
    (r,) = protocols.collect()
    assert (r.protocol_id, r.pdf_path, r.text_path, r.protocol_url, len(r.segments)) == ("demo-a", "/root-dir/src/demo-a.pdf", f"{folder}/demo-a.txt", "https://e.org/a.pdf", 4)


def test_models(spark):
    assert [(r.name, r.model) for r in readers.models(spark, MODELS, inline=True).orderBy("model_pos").collect()] == [("m1", "v/m1"), ("m2", "m2"), ("m3", "m3")]
    with pytest.raises(Exception, match="invalid model entry 2"):
        readers.models(spark, '[{"id": "a", "api": "x"}, {"api": "x"}]', inline=True).collect()


def test_golden(result):
    rows = {r.model_name: r for r in result.by_model.collect()}
    assert (rows["m1"].avg_library_similarity, rows["m1"].library_exact_rate, rows["m1"].avg_ordered_region_accuracy) == (1.0, 1.0, 1.0)
    assert abs(rows["m2"].avg_library_similarity - 0.8) < 1e-12 and rows["m2"].avg_ordered_region_accuracy == 0.5
    assert (rows["m3"].runs, rows["m3"].successes, rows["m3"].failures, rows["m3"].avg_library_similarity) == (1, 0, 1, 0.0)
    regions = {r.region: r for r in result.by_model_and_region.filter("model_name = 'm2'").collect()}
    assert {k: (v["count"], v.region_exact_rate, v.sequence_exact_rate, v.length_exact_rate, v.char_exact_rate) for k, v in regions.items()} == {"known": (2, 0.5, 0.5, 0.5, 0.0), "barcode": (1, 1.0, 1.0, 1.0, 1.0), "umi": (1, 0.0, 0.0, 0.0, 0.0)}
    assert result.regions.filter("model_name = 'm3'").isEmpty()
    runs = {r.model_name: r for r in result.runs.collect()}
    assert runs["m1"].placeholder_key_exact and runs["m2"].placeholder_key_exact and not runs["m2"].segment_count_match
    assert (runs["m3"].gt_library_length, runs["m3"].gt_segment_count, runs["m3"].error) == (15, 4, "Request failed: refused")


def test_surplus_and_empty(spark):
    seg = "struct<name:string,type:string,char:string,sequence:string,length:bigint,empty:boolean>"
    s = ("n", "known", "", "AC", None, False)
    rows = spark.createDataFrame([("m", "p", "AC", "AC", [s], [s, s], "{}", "{}", None, 1.0), ("m", "q", "", "", [], [s], "{}", "{}", "", 1.0)], f"model_name string, protocol_id string, gt_library string, pred_library string, gt_segments array<{seg}>, pred_segments array<{seg}>, gt_placeholders string, pred_placeholders string, error string, duration_seconds double")
    a, b = score.score_runs(rows).orderBy("protocol_id").collect()
    assert (a.ordered_region_accuracy, a.segment_count_match, b.ordered_length_accuracy, b.library_similarity) == (1.0, False, 1.0, 1.0)
    assert aggregate.by_model(score.score_runs(rows)).first().successes == 2
    assert aggregate.by_model(score.score_runs(rows.limit(0))).count() == 0


def test_bad_responses(spark):
    rows = readers.predictions(spark.createDataFrame([("{",), ("[1]",), ('{"result": 3}',), (None,)], "response string")).collect()
    assert [r.error for r in rows] == ["Invalid JSON from benchmark API", "Benchmark API returned a non-object JSON response", None, "Invalid JSON from benchmark API"]
    assert rows[2].pred_library == "" and rows[2].pred_segments == []


def test_selection(spark):
    rows = spark.createDataFrame([("a-v3.1.json", "a-v3.1"), ("a-v3.json", "a-v3"), ("b.json", "b")], "file_name string, id string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(select.first_rows(rows, 1, "file_name")) == ["a-v3.1"] and len(ids(select.first_rows(rows, -1, "file_name"))) == 2 and len(ids(select.first_rows(rows, None))) == 3
    wanted = select.wanted_ids(spark.createDataFrame([(" b ",), ("",), ("zz",), ("yy",)], "id string"), "id")
    assert ids(select.keep_wanted(rows, wanted, "id")) == ["b"]
    with pytest.raises(ValueError, match="yy, zz"):
        select.refuse_unknown(rows, wanted, "id")


def test_routing(spark):
    rows = spark.createDataFrame([("p", "t", "u"), (None, "t", "u"), (None, None, "u"), (None, None, "")], "pdf_path string, text_path string, protocol_url string")
    assert [(r.source_used, r.error) for r in select.route_input(rows, "auto").collect()] == [("p", None), ("t", None), ("u", None), ("", "no usable input source found")]
    assert select.route_input(rows, "pdf").collect()[1].error == "missing protocol PDF"
    with pytest.raises(ValueError):
        select.route_input(rows, "name")


def test_label(spark):
    r = aggregate.region_labels(spark.createDataFrame([("a::b", "umi")], "model_name string, region string")).first()
    assert (r.label_model, r.label_region) == ("a", "b::umi")


def test_pages(spark):
    rows = spark.createDataFrame([("d", 1, "p1"), ("d", 2, " \n"), ("d", 3, "p3")], "doc string, page int, text string")
    assert aggregate.join_pages(rows, "doc").first().text == "--- Page 1 ---\np1\n\n--- Page 3 ---\np3"


def test_download_plan(spark, tmp_path):
    bad = {"a.json": "{", "b.json": '{"references": {"protocol_link": 3}}', "c.json": '{"references": {"protocol_pdf": "HTTPS://e.org/x.pdf"}, "protocol_id": " c "}', "d.json": '{"references": {"protocol_pdf": "s/d.pdf"}}', "e.json": "[]", "f.json": '{"references": 3}'}
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
    rows = {r.file_name: r for r in readers.download_plan(readers.read_json_files(spark, str(tmp_path), strict=False)).collect()}
    assert set(rows) == {"a.json", "b.json", "c.json", "d.json"} and rows["a.json"].issue == "invalid JSON" and rows["b.json"].issue
    assert (rows["c.json"].protocol_id, rows["c.json"].url, rows["c.json"].target_path) == ("c", "HTTPS://e.org/x.pdf", None)
    assert (rows["d.json"].protocol_id, rows["d.json"].url, rows["d.json"].target_path) == ("d", None, "s/d.pdf")

    def get(url):
        return (b"", None, url)

    done = {r.protocol_id: r.status for r in seams.fetch(readers.download_plan(readers.read_json_files(spark, str(tmp_path), strict=False)), get).collect()}
    assert done["c"] == "error" and done["d"] == "skipped"


def test_seams(spark):
    docs = spark.createDataFrame([("a", bytearray(b" x ")), ("b", bytearray(b"bad"))], "path string, content binary")

    def load():
        def recognise(content):
            if content == b"bad":
                raise ValueError("no text")
            return content.decode()

        return recognise

    assert [(r.path, r.text, r.error) for r in seams.ocr(docs, load).orderBy("path").collect()] == [("a", "x", None), ("b", None, "no text")]
    assert seams.pick_device(lambda d: d == "mps") == "mps" and seams.pick_device(lambda d: False) == "cpu"
    body = seams.multipart({"model": "m"}, [("file", "a.pdf", b"%", "application/pdf")], "xx")
    assert body.count(b"--xx") == 3 and b'filename="a.pdf"' in body


def test_sinks(spark, result, tmp_path):
    assert sinks.write_csv(result.runs, sinks.RUN_COLUMNS, str(tmp_path / "runs"), ("model_name",))
    text = (tmp_path / "runs").read_text()
    assert text.splitlines()[0].split(",")[0] == "protocol_id" and ",True," in text and len(text.splitlines()) == 4
    assert not sinks.write_csv(result.runs.limit(0), sinks.RUN_COLUMNS, str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.write_csv(result.regions, sinks.REGION_COLUMNS, str(tmp_path / "regions"), ("model_name", "segment_index"))
    text = (tmp_path / "regions").read_text().splitlines()
    assert text[0] == ",".join(sinks.REGION_COLUMNS) and len(text) == 9 and text[2] == "demo-a,m1,1,cb,barcode,barcode,barcode,True,4,4,True,1.0,True,B,B,True,True"
    lines = sinks.envelope(result.runs, result.regions, result.by_model, result.by_model_and_region, result.counts, "a", "b", "text", "models.json").collect()
    whole = json.loads("\n".join(r.value for r in lines))
    assert list(whole) == ["run_started_at", "run_finished_at", "models_file", "input_mode", "protocol_count", "model_count", "results", "region_results", "summary"]
    assert (whole["models_file"], whole["protocol_count"], whole["model_count"], len(whole["region_results"])) == ("models.json", 1, 3, 8) and "m2::umi" in whole["summary"]["by_model_and_region"]
    assert [r["model_name"] for r in whole["results"]] == ["m1", "m2", "m3"] and whole["results"][0]["prediction"]["protocol_name"] == "Demo" and "raw_output" not in whole["results"][0]
    assert (whole["results"][2]["source_used"], whole["results"][2]["error"]) == ("", "Request failed: refused") and "prediction" not in whole["results"][2]
    lines = [r.line for r in sinks.report_lines(result.by_model, result.by_model_and_region).collect()]
    assert lines[:2] == ["", "Average by model:"] and lines[3] == "  m2: similarity=0.800 exact=0.000 region=0.500 success=1/1"


def test_extras(spark, protocols, result):
    assert protocols.transform(aggregate.consistency).first().segments_make_library
    assert {r.model_name: round(r.similarity_with_failures, 3) for r in aggregate.failures_as_zero(result.runs).collect()} == {"m1": 1.0, "m2": 0.8, "m3": 0.0}


def test_stream(spark, protocols, tmp_path):
    arriving = tmp_path / "in"
    arriving.mkdir()
    line = json.dumps({"model_name": "m1", "protocol_id": "demo-a", "response": answer(seams.Request("v/m1", "", "text", "")), "error": None, "duration_seconds": 1.0})
    (arriving / "1.json").write_text(line + "\n")
    for expected in (1, 2):
        score_available(spark, str(arriving), protocols, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).filter("library_similarity = 1.0").count() == expected
        (arriving / "2.json").write_text(line + "\n")


def test_mutation(spark, protocols):
    """One changed character shows in the scores."""

    def wrong(r):
        return answer(seams.Request("v/m1", "", "text", "")).replace("ACGTBBBB", "ACGABBBB")

    changed = benchmark.run(readers.models(spark, MODELS, inline=True), protocols, wrong, "text").by_model
    assert all(0 < r.avg_library_similarity < 1 and r.library_exact_rate == 0 for r in changed.collect())
    assert changed.select(F.sum("successes")).first()[0] == 3
