"""Scalar functions and edge rules, against small literal cases and an independent edit distance."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from libgauge.functions.segments import integer_at, region, segment_length, segments_at, string_at
from libgauge.functions.text import newline_count, path_stem, path_suffix, safe_filename, similarity, strip
from libgauge.functions.urls import guess_extension, is_web


def edit_distance(a: str, b: str) -> int:
    """Wagner and Fischer's table, whole."""
    table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return table[len(a), len(b)]


def test_similarity_model(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("ACGTBUILé") for _ in range(rng.randrange(0, 14)))
    pairs = [(make(), make()) for _ in range(120)] + [("", ""), ("", "A"), ("A", ""), ("ACGT", "ACGT")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s"), similarity(F.col("b"), F.col("a")).alias("t")).collect()
    for r in rows:
        longer = max(len(r.a), len(r.b))
        assert abs(r.s - (1 - edit_distance(r.a, r.b) / longer if longer else 1.0)) < 1e-12
        assert r.s == r.t and 0 <= r.s <= 1


def test_text(spark):
    one = spark.createDataFrame([("\t a \n  \x1c", "10x v3 / 5 prime!", "///", "a\nb\n")], "x string, n string, m string, l string")
    r = one.select(strip(F.col("x")).alias("x"), safe_filename(F.col("n")).alias("n"), safe_filename(F.col("m")).alias("m"), newline_count(F.col("l")).alias("l")).first()
    assert (r.x, r.n, r.m, r.l) == ("a", "10x-v3-5-prime", "protocol", 2)
    names = spark.createDataFrame([("d/a.b.json",), (".hidden",), ("x",), ("a.",), ("a.b",)], "p string").select(path_stem(F.col("p")).alias("s"), path_suffix(F.col("p")).alias("x")).collect()
    assert [(r.s, r.x) for r in names] == [("a.b", ".json"), (".hidden", ""), ("x", ""), ("a.", ""), ("a", ".b")]


def test_urls(spark):
    rows = spark.createDataFrame([(None, "https://e.org/CG.RevB.PDF?d=1"), ("text/html", "https://e.org/a.pdf"), ("x/y", "http://e.org/"), (None, None), (None, "https://e.org")], "t string, u string")
    assert [r.e for r in rows.select(guess_extension(F.col("t"), F.col("u")).alias("e")).collect()] == [".pdf", ".html", ".bin", ".bin", ".bin"]
    assert [r.w for r in spark.createDataFrame([("HTTPS://x",), ("ftp://x",), ("a/b.pdf",), (None,)], "u string").select(is_web(F.col("u")).alias("w")).collect()] == [True, False, False, False]


def test_segments_from_json(spark):
    doc = '{"s": [{"type": "barcode", "char": "L", "sequence": "AC", "length": 8}, 3, null, {"sequence": "AC", "length": 8.0}, {"length": true}, {"sequence": "ACG", "length": "9"}, {}, {"sequence": 5, "type": " UMI "}, {"char": " ", "type": ""}]}'
    typed = spark.createDataFrame([(doc,)], "d string").select(F.parse_json("d").alias("v")).select(F.expr(segments_at("v", "$.s")).alias("s"))
    rows = typed.select(F.explode("s").alias("s")).select(region(F.col("s")).alias("region"), segment_length(F.col("s")).alias("n"), F.col("s.sequence").alias("seq")).collect()
    assert [(r.region, r.n, r.seq) for r in rows] == [("ligation", 8, "AC"), ("unknown", 2, "AC"), ("unknown", 1, ""), ("unknown", 3, "ACG"), ("missing", 0, ""), ("umi", 0, ""), ("unknown", 0, "")]


def test_guards(spark):
    rows = spark.createDataFrame([('{"a": 8}',), ('{"a": "x"}',), ('{"a": null}',), ("{}",), ("[1]",)], "d string").select(F.parse_json("d").alias("v"))
    got = rows.select(F.expr(string_at("v", "$.a")).alias("s"), F.expr(integer_at("v", "$.a")).alias("i"), F.size(F.expr(segments_at("v", "$.a"))).alias("n")).collect()
    assert [(r.s, r.i, r.n) for r in got] == [("", 8, 0), ("x", None, 0), ("", None, 0), ("", None, 0), ("", None, 0)]
