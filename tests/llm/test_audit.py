"""The filter audit against a walk of every row through every order."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from libgauge.llm import filter_audit
from libgauge.llm.common import Workspace


def rows_of(rng):
    words = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    texts = [words(rng.randrange(1, 420), rng.choice((30, 90, 4000))) for _ in range(40)] + ["", " \n", None, "A B C", "é|x", "x" * 300, words(30_000, 20_000), "Ab " * 250, "$ " * 300]
    rows = [(k, rng.choice(texts), rng.choice(("big", "big", "other", None, ""))) for k in range(150)]
    rows += [rows[3], rows[3], (7, "another text of id 7", "big"), (8, rows[20][1], "other"), (None, rows[5][1], "big"), (None, None, None), (-4, rows[20][1], "big")]
    return rows


def slow(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = Counter()
    flagged = []
    for i, t, part in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        flagged.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    for part in {f[0] for f in flagged}:
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                out[part, order, step, "x"] = x
    for part, fails, g, t in flagged:
        for order in map("".join, permutations("ABCDE")):
            gone = next((k for k, x in enumerate(order, 1) if x in fails), 6)
            for step, x in enumerate(order, 1):
                key = (part, order, step)
                out[*key, "kept"] += gone > step
                out[*key, "removed"] += gone == step
                out[*key, "redundant"] += gone < step and x in fails
                out[*key, "unique_fails"] += fails == {x}
                out[*key, "good_lost"] += gone == step and g
                out[*key, "toxic_lost"] += gone == step and t
                out[part, x, "shapley"] += gone == step
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("audit"))
    rng = random.Random(3)
    rows = rows_of(rng)
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("part", "mark", "n", "A", "least")}).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, labels


def test_every_order(spark, folder):
    d, rows, labels = folder
    got, want = filter_audit.op12_filter_audit(spark, d).collect(), slow(rows, labels)
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got}) == 600 * len({p or "" for *_, p in rows})
    for r in got:
        key = (r.part, r.filter_order, r.step)
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[*key, name], (key, name)
        assert r.shapley == want[r.part, want[*key, "x"], "shapley"]
    Workspace.close_all()


def test_all_parts_together_and_fewer_filters(spark, folder):
    d, rows, _ = folder
    counted = filter_audit.flag_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    whole = filter_audit.audit(counted, "AD").filter("part IS NULL").collect()
    assert sorted({r.filter_order for r in whole}) == ["AD", "DA"] and len(whole) == 4
    assert all(r.removed + r.kept == len(rows) for r in whole if r.step == 1) and len({r.kept for r in whole if r.step == 2}) == 1
    Workspace.close_all()


def test_cube_has_what_is_left(spark, folder):
    d, _, _ = folder
    counted = filter_audit.flag_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).cache()
    flags = counted.collect()
    for r in filter_audit.survivors(counted).collect():
        some = [f for f in flags if (r.part is None or f.part == r.part) and not any(f[x] for i, x in enumerate("ABCDE") if r.subset >> i & 1)]
        assert (r.n, r.good, r.toxic) == tuple(sum(f[x] for f in some) for x in ("n", "good", "toxic"))
    counted.unpersist()


def test_no_rows(spark, folder, tmp_path):
    d, _, _ = folder
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert filter_audit.op12_filter_audit(spark, str(tmp_path)).count() == 0
    Workspace.close_all()
