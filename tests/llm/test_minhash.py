"""MinHash near-duplicates against all pairs; posterior bounds against integration."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from libgauge.llm import minhash
from libgauge.llm.common import Workspace
from libgauge.llm.ngram_join import Roots


def made():
    rng = random.Random(21)
    words = lambda n, v=5000: [f"w{rng.randrange(v)}" for _ in range(n)]

    def changed(w, n):
        w = list(w)
        for k in rng.sample(range(len(w)), n):
            w[k] = f"new{rng.randrange(10**6)}"
        return w

    texts = [words(rng.randrange(1, 260)) for _ in range(120)]
    base = words(200)
    texts += [changed(base, rng.randrange(1, 24)) for _ in range(60)]  # some pairs link, some don't
    chain = words(150)
    for _ in range(12):  # ends don't link with each other
        chain = changed(chain, 6)
        texts.append(chain)
    for k in range(20):  # near the threshold from both sides
        texts.append(changed(texts[k], max(1, len(texts[k]) // 18)))
        texts.append(changed(texts[k], max(1, len(texts[k]) // 16)))
    texts += [words(9000, 900)]
    texts += [changed(texts[-1], 300)]
    out = [" ".join(t) for t in texts]
    out += [out[0], out[0].upper(), out[1].replace(" ", "\n\t"), None, "", " \n", "one", "ONE", "one two", "é é é", "one two one two one"]
    rows = list(enumerate(out)) + [(0, out[0]), (3, out[3]), (7, "other text of seven"), (None, out[4]), (None, "alone without id"), (-9, out[130])]
    rng.shuffle(rows)
    return rows


def slow(rows, n, percent):
    def shingles(t):
        w = (t or "").translate({k: k + 32 for k in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    roots = Roots()
    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= percent * len(x | sets[b]):
                roots.join(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[roots.find(k)] = min(i, least.get(roots.find(k), i))
    return sorted(((i, len(s), c := least.get(roots.find(k)), i == c) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("minhash"))
    spark.createDataFrame(made(), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "print", "n", "root", "minima", "token", "part")}).repartition(5).write.parquet(f"{d}/documents.parquet")
    return d


def test_every_document(spark, folder):
    assert sorted(map(tuple, minhash.op11_minhash_dedup(spark, folder).collect()), key=str) == slow(made(), 2, 80)
    Workspace.close_all()


def test_small_blocks_another_layout_and_other_parameters(spark, folder, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 2)
    real = minhash.mixed
    monkeypatch.setattr(minhash, "mixed", lambda *a: real(*a, longest=3))
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(1)
    assert sorted(map(tuple, minhash.near_duplicates(docs, 5, 80).collect()), key=str) == slow(made(), 5, 80)
    Workspace.close_all()


def test_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(docs.filter("text IS NULL")).collect()] == [(i, 0, i, True) for i, t in made() if t is None]
    Workspace.close_all()


def test_posterior_bounds():
    """The least numbers of matches by plain integration of the posterior."""
    s = np.linspace(0, 1, 200_001)
    for n, least in zip(range(16, 161, 16), minhash.least_matches(80, 1e-6)):
        for m, reached in ((least, True), (least - 1, False)):
            if m >= 0:
                density = s**m * (1 - s) ** (n - m)
                assert (density[s >= 0.8].sum() / density.sum() >= 1e-6) == reached


def test_pairs_over_the_threshold_survive():
    rng = np.random.default_rng(3)
    kept = pruned = 0
    for _ in range(300):
        union = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
        for share in (0.8, 0.3):
            common = int(share * 500)
            a, b = np.sort(union[: common + (500 - common) // 2]), np.sort(np.r_[union[:common], union[common + (500 - common) // 2 :]])
            alive, _ = minhash.plausible(minhash.minima(a), minhash.minima(b)[None], 80)
            kept += share == 0.8 and len(alive)
            pruned += share == 0.3 and not len(alive)
    assert (kept, pruned) == (300, 300)


def test_pairs_of_different_home_blocks(spark):
    """A long list: sets outside its largest component are compared with each other, whatever their home blocks."""
    rng = np.random.default_rng(8)
    common = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    own = [np.sort(np.append(common, np.uint64(2 * k + 1))) for k in range(24)]
    sets = spark.createDataFrame([(k, len(s), bytearray(minhash.minima(s).tobytes()), bytearray(minhash.parity(s)), None) for k, s in enumerate(own)], "node long, n long, minima binary, sketch binary, wide binary")
    roots = [0 if k < 4 else k for k in range(24)]
    lists = spark.createDataFrame([(1, k) for k in range(24)], "token long, node long")
    members = minhash.mixed(lists, spark.createDataFrame(list(enumerate(roots)), "node long, root long"), sets, longest=3)
    pairs = sorted(map(tuple, minhash.open_pairs(members, 80, False).collect()))
    assert pairs == [(a, b) for a in range(24) for b in range(a + 1, 24) if roots[a] != roots[b]]
    joined = Roots()
    for a, b in minhash.open_pairs(members, 80, True).collect():
        joined.join(roots[a], roots[b])
    assert {joined.find(r) for r in roots} == {0}
