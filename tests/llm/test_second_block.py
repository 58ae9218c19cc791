"""A deal of more sets than one block of the search."""

from __future__ import annotations

import random

import numpy as np

from libgauge.llm import ngram_join


def test_links_across_blocks(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(100_000)}"
    sets = lambda t: ngram_join.shingle_sets(np.frombuffer(t.encode(), np.uint8), 3)
    least = min((" ".join(word() for _ in range(3)) for _ in range(30_000)), key=lambda t: sets(t)[0])
    texts = []
    for _ in range(900):
        tail = [word() for _ in range(25)]
        texts += [" ".join([least, *tail]), " ".join([least, *tail, word()])]
    found = [sets(t) for t in texts]
    assert sum(s[0] == sets(least)[0] for s in found) > ngram_join.BLOCK
    linked = [100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)) for a, b in zip(found[::2], found[1::2])]
    assert all(linked)  # pairs only: different tails share three shingles of 27 at most
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()}
    assert got == {k: k - k % 2 for k in range(len(texts))}


def family(rng, count, size, changed):
    """Texts that differ from each other in about two times ``changed`` words, at words of their own."""
    base = [f"b{k}" for k in range(size)]
    texts = []
    for _ in range(count):
        w = list(base)
        for at in rng.sample(range(0, size, 4), changed):
            w[at] = f"c{rng.randrange(1_000_000)}"
        texts.append(" ".join(w))
    return texts


def test_family_under_the_threshold(spark):
    """2,000 texts alike in some 0.88: no links but for planted ones, and few pairs to count."""
    rng = random.Random(5)
    base = " ".join(f"b{k}" for k in range(280))
    texts = [base + "".join(f" t{rng.randrange(1_000_000)}" for _ in range(18)) for _ in range(2000)]
    texts += [texts[k] + " z" for k in range(0, 300, 3)]  # links with its twin
    sets = [ngram_join.shingle_sets(np.frombuffer(t.encode(), np.uint8), 3) for t in texts]
    some = [len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s)) for s in sets[1:200]]
    assert 0.86 < np.mean(some) < 0.9
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()}
    index, roots = ngram_join.DivideSkip(sets), ngram_join.Roots()
    for k, s in enumerate(sets):
        common = np.bincount(index.lists[np.concatenate([np.arange(index.starts[t], index.ends[t]) for t in np.searchsorted(index.tokens, s)])], minlength=len(sets))
        for c in np.flatnonzero(100 * common >= 90 * (len(s) + index.sizes - common)):
            roots.join(k, int(c))
    assert got == {k: roots.find(k) for k in range(len(texts))}


def test_split_lists(spark, monkeypatch):
    """Deals and lists of a few sets: all links are found across their parts."""
    monkeypatch.setattr(ngram_join.first_links, "__defaults__", (7,))
    monkeypatch.setattr(ngram_join.mixed_lists, "__defaults__", (5,))
    rng = random.Random(6)
    texts = family(rng, 150, 120, 1) + family(rng, 60, 90, 3) + family(random.Random(7), 100, 120, 2)
    sets = [set(zip(w, w[1:], w[2:])) for w in map(str.split, texts)]
    roots = ngram_join.Roots()
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                roots.join(a, b)
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()}
    assert got == {k: roots.find(k) for k in range(len(texts))} and len(set(got.values())) > 5
