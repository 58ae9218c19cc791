"""What operators leave on the executors' disks."""

from __future__ import annotations

from pyspark.sql import functions as F

from libgauge.llm import ngram_join, suffix_dedup
from libgauge.llm.common import Workspace

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffled(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_saved_tables_leave_no_shuffle_files(spark):
    work, before, setting = Workspace(spark, "disk"), shuffled(spark), spark.conf.get(KEY)
    kept = work.save(spark.range(20_000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")), "sums")
    again = work.save(kept.join(kept.groupBy("k").count(), "k").repartition(3), "joined")
    assert not shuffled(spark) - before and spark.conf.get(KEY) == setting
    assert again.count() == 7 and again.agg(F.sum("s")).first()[0] == sum(range(20_000))
    work.close()


def test_tables_of_the_join_go_when_they_are_read(spark, monkeypatch):
    """Beside the rows of ``keep_one``, while labels are moved a second time: sets, the labels before and the pairs that link."""
    seen, real = {}, Workspace.save

    def save(self, df, table):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = self._files(path)
        seen[table] = {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()
        return real(self, df, table)

    monkeypatch.setattr(Workspace, "save", save)
    rows = [(k, " ".join(f"w{(k % 10) * 100 + i}" for i in range(60)) + f" end{k % 20}") for k in range(60)]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert {r.doc_id: r.component_id for r in found.collect()} == {k: k % 10 for k in range(60)}
    assert seen["rest_labels_edges"] <= {"sets", "forest_labels_first", "rest"} | {t for t in seen if t.startswith("forest_labels_")}
    Workspace.close_all()


def saved_plans(spark, monkeypatch):
    """The plans of tables as they are saved."""
    plans, real = {}, Workspace.save

    def save(self, df, table):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return real(self, df, table)

    monkeypatch.setattr(Workspace, "save", save)
    return plans


def test_texts_are_moved_once(spark, monkeypatch):
    """Only replies and columns beside the text are shuffled once the chunks are there."""
    plans, key = saved_plans(spark, monkeypatch), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    passage = " ".join(f"passage{i}" for i in range(40))
    rows = [(k, "".join(f" own{k}x{i}" for i in range(60)) + chr(0x4E00 + k) + (passage if k % 2 else ""), k * 3) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, beside long")
    try:
        spark.conf.set(key, "-1")
        left = suffix_dedup.cut_repeats(docs)
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
        assert plans["result"].count("Exchange hashpartitioning") == 1
        assert {tuple(r) for r in left.collect()} == {(k, t.replace(passage, ""), b) for k, t, b in rows}
        ngram_join.keep_one(docs)
        assert plans["sets"].count("Exchange hashpartitioning") == 1
        assert plans["first"].count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set(key, before)
    Workspace.close_all()


def test_lists_of_the_same_members_are_one(spark):
    first = spark.createDataFrame([(1, 1, [10, 11, 12, 13]), (2, 2, [10, 11, 12, 14]), (3, 3, [12, 13, 20]), (4, 3, [20])], "node long, root long, prefix array<long>")
    lists = {}
    for r in ngram_join.shared_lists(first).collect():
        lists.setdefault(r.token, []).append((r.node, r.root))
    assert sorted(map(sorted, lists.values())) == [[(1, 1), (2, 2)], [(1, 1), (2, 2), (3, 3)], [(1, 1), (3, 3)]]
