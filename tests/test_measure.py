"""Edit distances: bands, bit-parallel columns, and how the work is dealt."""

from __future__ import annotations

import random
import statistics

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from libgauge.functions import distance
from libgauge.operators import aggregate, measure, score
from libgauge.operators.number import deal_by_cost
from libgauge.plans.queries import QUERIES
from libgauge.store import Store, close_all

SMALLEST = "/root/testdata/sf0.001"


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé😀\n", max_size=40), st.text("abé😀\n", max_size=40))
def test_columns_and_diagonals(a, b):
    want = slow(a, b)
    assert distance.edit_distance(a, b) == want
    assert not a or not b or distance.by_columns(*sorted((a, b), key=len, reverse=True)) == want
    for limit in (0, want - 1, want, want + 1, want + 7):
        if limit >= 0:
            assert distance.along_diagonals(a, b, limit) == (want if want <= limit else None)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        rng.choice((lambda: text.insert(k, "x"), lambda: text.pop(k), lambda: text.__setitem__(k, "y")))()
    return "".join(text)


def test_near_texts_of_any_length():
    """Few edits in long texts: columns and diagonals agree, and diagonals take their time from the distance."""
    import time

    rng = random.Random(5)
    for size, n in ((3000, 25), (3000, 40), (20_000, 150)):
        a = "".join(rng.choice("abcd efgh\n") for _ in range(size))
        b = edited(rng, a, n)
        assert distance.edit_distance(a, b) == distance.by_columns(*sorted((a, b), key=len, reverse=True)) <= n
    a = "".join(rng.choice("abcd efgh\n") for _ in range(3_000_000))
    began = time.monotonic()
    assert 0 < distance.edit_distance(a, edited(rng, a, 300)) <= 300
    assert time.monotonic() - began < 30  # columns would take half an hour


def test_long_columns():
    rng = random.Random(4)
    for n, m in ((600, 580), (700, 90), (513, 513)):
        a, b = ("".join(rng.choice("acgté\U0001f600") for _ in range(k)) for k in (n, m))
        assert distance.edit_distance(a, b) == slow(a, b)


def texts():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé😀 ") for _ in range(n))
    pairs = [(word(rng.randrange(0, 90)), word(rng.randrange(0, 90))) for _ in range(120)]
    for _ in range(60):  # near ones, of every band
        a = list(word(80))
        b = list(a)
        for _ in range(rng.randrange(0, 30)):
            b[rng.randrange(len(b))] = "#"
        pairs.append(("".join(a), "".join(b[rng.randrange(0, 4) :])))
    return pairs + [("", ""), ("", "é"), ("x", ""), pairs[0], pairs[0]]


def test_expressions(spark):
    pairs = texts()
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)] + [(len(pairs), None, "x")], "k int, a string, b string")
    near = distance.banded(F.col("a"), F.col("b"))
    got = rows.select("k", near.alias("near"), distance.far(F.col("a"), F.col("b"), near).alias("d"), distance.as_similarity(F.col("d"), F.col("a"), F.col("b")).alias("s")).orderBy("k").collect()
    for (a, b), r in zip(pairs, got):
        d, n = slow(a, b), max(len(a), len(b))
        assert r.d == d and r.s == (1.0 if a == b else 1.0 - d / n)
        assert r.near == (d if d <= distance.BANDS[-1] or not a or not b else None)
    assert got[-1].d is None


def test_each_pair_once(spark):
    """Arrays of pairs get their distances, in order; distinct pairs that no band settles are measured once."""
    pairs = texts()
    rng = random.Random(2)
    rows = [(k, [rng.choice(pairs) for _ in range(rng.randrange(0, 9))]) for k in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "k int, pairs array<struct<left:string,right:string>>").withColumns({c: F.lit("clash") for c in ("row", "place", "key", "left", "near")})
    store = Store(spark)
    got = {r.k: r.found for r in measure.distances(df, F.col("pairs"), "found", store).collect()}
    assert got == {k: [slow(*p) for p in ps or ()] for k, ps in rows}
    open_ = {p for _, ps in rows for p in ps or () if slow(*p) > distance.BANDS[-1] and all(p)}
    exploded = df.select(F.inline("pairs")).withColumn("near", distance.banded(F.col("left"), F.col("right"))).filter("near IS NULL")
    assert measure.measure_pairs(exploded, store).count() == len(open_)
    store.close()


SEGMENT = "struct<name:string,type:string,char:string,sequence:string,length:bigint,empty:boolean>"


def runs(spark, rows):
    return spark.createDataFrame(rows, f"model_name string, protocol_id string, gt_library string, pred_library string, gt_segments array<{SEGMENT}>, pred_segments array<{SEGMENT}>, gt_placeholders string, pred_placeholders string, error string, duration_seconds double")


def long_runs(spark):
    """Many short runs and one of 10,000 segments."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    segment = lambda n: ("s", "known", "", word(n), None, False)
    rows = [("m", f"p{k}", word(60), word(60), [segment(50) for _ in range(4)], [segment(50) for _ in range(5)], "{}", "{}", "bad" if k % 9 == 0 else None, 1.0) for k in range(150)]
    rows.append(("m", "long", word(300), word(300), [segment(50) for _ in range(10_000)], [segment(50) for _ in range(10_000)], "{}", "{}", None, 1.0))
    return runs(spark, rows + [("m", "none", None, None, None, None, None, None, None, 1.0)])


def test_tasks_of_equal_cost(spark):
    df = long_runs(spark)
    pieces = df.filter("error IS NULL").select(F.inline(measure.run_texts(F.col("gt_segments"), F.col("pred_segments"), F.col("gt_library"), F.col("pred_library"))))
    dealt = deal_by_cost(pieces.distinct(), distance.cost(F.col("left"), F.col("right")), 16)
    work = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(distance.cost(F.col("left"), F.col("right"))).alias("cost")).collect()
    assert len(work) == 16 and max(r.cost for r in work) < 1.1 * statistics.median(r.cost for r in work)
    close_all()


def test_scores_are_the_same_either_way(spark):
    df, store = long_runs(spark), Store(spark)
    shown = lambda scored: {r.protocol_id: r for r in scored.select("protocol_id", "library_similarity", "ordered_sequence_accuracy", "gt_segment_count", F.transform("aligned", lambda a: a["sequence_similarity"]).alias("s")).collect()}
    assert shown(score.score_runs(df, store)) == shown(score.score_runs(df))
    store.close()


def test_nothing_to_measure(spark):
    store = Store(spark)
    scored = score.score_runs(long_runs(spark).limit(0), store)
    assert scored.count() == 0 and aggregate.by_model(scored).count() == 0
    store.close()


def test_costs_with_one_dear_row(spark):
    rows = spark.createDataFrame([(k, 1000.0 if k == 0 else 1.0) for k in range(400)], "k int, c double")
    per = {r.task: r.c for r in deal_by_cost(rows, F.col("c"), 8).groupBy(F.spark_partition_id().alias("task")).agg(F.sum("c").alias("c")).collect()}
    assert sorted(per.values())[:7] == pytest.approx([50.0] * 7, abs=1.0)
    assert deal_by_cost(rows.limit(0), F.col("c"), 8).count() == 0
    close_all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abé😀\n", min_size=1, max_size=200), st.text("abé😀\n", min_size=1, max_size=200)), min_size=1, max_size=12))
def test_columns_of_many_pairs_together(pairs):
    pairs = sorted(((a, b) if len(a) >= len(b) else (b, a) for a, b in pairs), key=distance.steps)
    assert distance.together(pairs) == [distance.by_columns(a, b) for a, b in pairs]


@pytest.mark.parametrize("table", [1 << 22, 2000])
def test_groups_of_all_lengths(monkeypatch, table):
    """Mixed lengths and alphabets in groups of some words, also where a table of places would be too large."""
    monkeypatch.setattr(distance, "WORDS", 40)
    monkeypatch.setattr(distance, "COMPANY", 10)
    monkeypatch.setattr(distance, "PLAIN", 600)
    monkeypatch.setattr(distance, "TABLE", table)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice(rng.choice(("ab", "abcdé😀 ", "".join(map(chr, range(0x4E00, 0x4F00)))))) for _ in range(n))
    pairs = [(word(rng.randrange(n)), word(rng.randrange(n))) for n in (2, 64, 66, 129, 700) for _ in range(40)]
    pairs += [(a, edited(rng, a, 20)) for a in (word(900) for _ in range(5))] + [(word(64), word(64)), (word(128), "a"), ("", "")]
    assert distance.edit_distances(pairs) == [distance.edit_distance(a, b) for a, b in pairs]


@pytest.mark.parametrize("name", ["q05_positional_align", "q10_char_exact_tristate", "q16_char_rate_zero_default", "q33_json_envelope"])
def test_queries_without_similarities_measure_nothing(spark, monkeypatch, name):
    monkeypatch.setattr(score, "distances", None)
    df = QUERIES[name](spark, SMALLEST)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() > 0 and "levenshtein" not in plan.lower()
    close_all()


@pytest.mark.parametrize("name, library", [("q37_progress_lines", True), ("q04_entry_model_summary", True), ("q15_region_summary", False), ("q52_region_csv_lines", False), ("q06_region_rows", False)])
def test_queries_measure_what_they_read(spark, monkeypatch, name, library):
    asked, real = [], score.run_texts
    monkeypatch.setattr(score, "run_texts", lambda *a: asked.append(a[4:]) or real(*a))
    assert QUERIES[name](spark, SMALLEST).count() > 0
    assert asked == [(library, not library)]
    close_all()
