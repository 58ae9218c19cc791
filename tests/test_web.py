"""The web source against a local server."""

from __future__ import annotations

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from libgauge.functions.urls import host
from libgauge.sources.web import plan_requests, read_web


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.headers["Host"].partition(":")[0], self.path, time.monotonic(), self.headers["User-Agent"]))
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/there.pdf")
                self.end_headers()
                return
            body = b"" if self.path == "/empty" else self.path.encode() * 3
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Type", "application/pdf; charset=x")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("0.0.0.0", 0), Handler)
    s.seen = seen
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def addresses(spark, server, *paths):
    return spark.createDataFrame([(f"http://{h}:{server.server_port}{p}",) for h in ("127.0.0.1", "localhost") for p in paths] + [(None,)], "url string")


def test_rows(spark, server, tmp_path):
    rows = addresses(spark, server, "/a", "/moved", "/none", "/empty", "/a")
    plan_requests(rows.unionByName(spark.createDataFrame([("http://127.0.0.1:9/down",)], "url string")), str(tmp_path / "plan"))
    got = {r.url: r for r in read_web(spark, str(tmp_path / "plan"), timeout=10).collect()}
    at = f"http://localhost:{server.server_port}"
    assert len(got) == 9 and bytes(got[at + "/a"].content) == b"/a/a/a" and got[at + "/a"].content_type == "application/pdf" and got[at + "/a"].error is None
    assert got[at + "/moved"].final_url == at + "/there.pdf" and bytes(got[at + "/empty"].content) == b""
    assert "404" in got[at + "/none"].error and got[at + "/none"].content is None and got["http://127.0.0.1:9/down"].error


def test_pace_by_host(spark, server, tmp_path):
    plan_requests(addresses(spark, server, *(f"/{k}" for k in range(5))), str(tmp_path / "plan"))
    server.seen.clear()
    assert read_web(spark, f"file://{tmp_path}/plan", rate=10).count() == 10
    for name in ("127.0.0.1", "localhost"):
        times = sorted(t for h, _, t, _ in server.seen if h == name)
        assert len(times) == 5 and min(b - a for a, b in zip(times, times[1:])) > 0.08


def test_no_addresses(spark, server, tmp_path):
    plan_requests(addresses(spark, server).filter("url IS NOT NULL"), str(tmp_path / "plan"))
    assert read_web(spark, str(tmp_path / "plan")).count() == 0


def test_hosts(spark):
    urls = {"HTTPS://User@E.org:80/a?b#c": "e.org", "http://[::1]:8/x": "[::1]", "mailto:x": "", "/path": "", "ftp://h": "h"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in rows.select("u", host(F.col("u")).alias("h")).collect()} == urls
