"""Results come from the data, not from how rows are dealt out; limits that grow with the data, made tiny."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from libgauge.llm import chat, mixing, ngram_join, suffix_dedup
from libgauge.llm.common import Workspace


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(14)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    texts = [words(rng.randrange(30, 200)) for _ in range(60)]
    texts += [[*t[: len(t) // 2], "changed", *t[len(t) // 2 + 1 :]] for t in texts[:20]]
    rows = [(k, " ".join(t), f"s{k % 3}") for k, t in enumerate(texts)]
    rows += [rows[3]] * 40 + [(7, "other text of seven", "s1"), (None, rows[5][1], "s0"), (None, None, None), (200, rows[61][1], "s2"), (9, rows[70][1], "s2")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))


def same_for_all_layouts(docs, make, *layouts):
    found = [sorted(map(str, make(docs.repartition(n)).collect())) for n in layouts or (1, 7)]
    assert found[0] and all(x == found[0] for x in found)
    Workspace.close_all()


def test_draws(spark, docs, tmp_path):
    def make(d):
        at = str(tmp_path / str(d.rdd.getNumPartitions()))
        d.write.parquet(f"{at}/documents.parquet")
        return mixing.op9_temperature_mixing(spark, at)

    same_for_all_layouts(docs, make, 1, 2, 7)


def test_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 5)
    same_for_all_layouts(docs, mixing.mix)


def test_copies_are_numbered(spark, docs):
    first, second = mixing.row_marks(docs)
    rows = docs.repartition(5).withColumns({"mark1": first, "mark2": second, "rid": F.monotonically_increasing_id()})
    got = mixing.among_copies(rows).groupBy("mark1", "mark2").agg(F.sort_array(F.collect_list("copy")).alias("c")).collect()
    assert all(r.c == list(range(len(r.c))) for r in got) and max(len(r.c) for r in got) == 41


def test_which_copy_stays(docs):
    same_for_all_layouts(docs, ngram_join.keep_one)
    kept = ngram_join.keep_one(docs).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(3) == 1 and 200 not in ids and ids.count(None) == 1 and {0, 1, 2, 5, 7, 9} <= set(ids)
    assert all(k not in ids for k in (60, 61, 62))  # near copies of 0, 1 and 2
    Workspace.close_all()


def test_other_columns_decide_among_equal_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = spark.createDataFrame([(1, text, f"s{k}") for k in range(6)], "doc_id long, text string, source string")
    same_for_all_layouts(rows, ngram_join.keep_one)


def test_pipeline_layouts_and_no_rows(spark, docs, tmp_path):
    import corpus_pipeline

    labels = docs.select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).filter("doc_id IS NOT NULL").distinct()
    found = []
    for n in (1, 7):
        at = str(tmp_path / str(n))
        docs.withColumn("lang", F.lit("en")).repartition(n).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        stage, kept = spark.read.parquet(f"{at}/documents.parquet"), []
        for k, (_, step) in enumerate(corpus_pipeline.STAGES[:4]):
            step(spark, stage, at).write.parquet(f"{at}/{k}")
            stage = spark.read.parquet(f"{at}/{k}")
            kept.append(sorted(map(str, stage.collect())))
        found.append(kept)
    assert found[0] == found[1]
    docs.withColumn("lang", F.lit("en")).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    Workspace.close_all()


def test_buckets_and_homes_of_any_number(docs):
    shown = lambda d: sorted(map(str, d.select("doc_id", "n_removed", "kept_sha256").collect()))
    want = shown(suffix_dedup.dedup(docs))
    assert shown(suffix_dedup.dedup(docs, bucket_bytes=20, most_homes=1)) == want
    Workspace.close_all()


def test_more_buckets_and_small_deals_in_the_join(docs, monkeypatch):
    want = sorted(map(str, ngram_join.join(docs).collect()))
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 30)
    monkeypatch.setattr(ngram_join, "DEAL_BYTES", 200)
    assert sorted(map(str, ngram_join.join(docs).collect())) == want
    Workspace.close_all()


def test_null_turns_come_first_and_have_their_own_placeholders(spark):
    image = [("image", None, "u", 28, 28, None, None)]
    rows = spark.createDataFrame([(1, t, "user", image) for t in (None, -1, -600, 700)], f"conv_id long, turn long, role string, parts {chat.PART.join(('array<', '>'))}")
    (r,) = chat.format_chats(rows.withColumn("text", F.lit(None).cast("string")), parts_col="parts").select(chat.formatted(F.col("chunks")).alias("t"), "attachments").collect()
    marks = [x.partition("|>")[0] for x in r.t.split("<|image:")[1:]]
    assert marks == ["-1.0", "-600.0", "-1~2.0", "700.0"] and [a.turn for a in r.attachments] == [None, -600, -1, 700]
