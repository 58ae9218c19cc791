"""Registered queries on a small folder, each column against a slow version."""

from __future__ import annotations

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from libgauge.llm import mixing, ngram_join, quality_rules, sharding
from libgauge.llm.tokens import encoder


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    made = [words(rng.randrange(1, 200)) for _ in range(260)]
    made += [made[0], made[1] + " x", "a b\na b\n# c\n" * 9, None, "", " \n", "w1 " * 40, "é& <|*>", words(30_000)]
    return made


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", None if i % 41 == 0 else "big" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 268)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def utf8(t):
    return (t or "").encode()


def test_op2(spark, folder, texts):
    rows = {r.doc_id: r for r in sharding.op2_slot_sharding(spark, folder).collect()}
    loads, places = Counter(), defaultdict(list)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(utf8(t)) + 8, zlib.crc32(utf8(t)), "bytes", None) and 0 <= r.shard < 24
        loads[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert len(rows) == len(texts) and all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(len(utf8(t)) for t in texts) + 8
    assert max(loads.values()) <= max(largest, 1.3 * (sum(loads.values()) - largest) / 23)


def test_op7(spark, folder, texts):
    rows = {r.doc_id: r for r in quality_rules.op7_quality_rules(spark, folder).collect()}
    for i, t in enumerate(texts):
        words = utf8(t).translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ")
        words = [w for w in words if w]
        met, again = set(), 0
        for line in utf8(t).split(b"\n"):
            if line.split():
                again += line in met
                met.add(line)
        windows = defaultdict(list)
        for k in range(len(words) - 7):
            windows[tuple(words[k : k + 8])].append(k)
        repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
        symbols = sum(w.decode().count(c) for w in words for c in "#*$%&|<>")
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), symbols, again, len(repeated))
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words)) and not (r.base_failed and r.kept)
    assert len(rows) == len(texts)


def slow_mix(totals):
    """Weights by a plain search for the exponent, and budgets in tokens."""
    has = {s: n for s, n in totals.items() if n}

    def plan(a):
        raw = {s: (n / sum(has.values())) ** a for s, n in has.items()}
        weight = {s: x / sum(raw.values()) for s, x in raw.items()}
        whole = max(n / weight[s] for s, n in has.items())
        return {s: weight[s] * whole for s in has}

    low, high = 0.0, 1.0
    for _ in range(80):
        a = (low + high) / 2
        low, high = (low, a) if max(b / has[s] for s, b in plan(a).items()) <= 1.5 else (a, high)
    return {s: math.floor(b + 0.5 + 1e-6) for s, b in plan(high).items()}


def test_op9(spark, folder, texts):
    rows = mixing.op9_temperature_mixing(spark, folder).collect()
    size = {i: len(encoder().ids(t or "")) // 4 for i, t in enumerate(texts)}
    source = {i: None if i % 41 == 0 else "big" if i % 3 else f"s{i % 4}" for i in range(len(texts))}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    budgets = slow_mix(totals)
    drawn, epochs = Counter(), defaultdict(list)
    for r in rows:
        assert r.tokens == size[r.doc_id] and r.source == source[r.doc_id]
        drawn[r.source] += r.tokens
        epochs[r.source, r.epoch].append((r.position, r.block, r.doc_id, r.tokens))
    for s, total in totals.items():
        full, rest = divmod(budgets[s], total)
        assert abs(drawn[s] - budgets[s]) <= max(size.values()) and drawn[s] <= budgets[s]
        for e in range(full):
            assert sorted(x[2] for x in epochs[s, e]) == sorted(i for i in source if source[i] == s)
        for e in range(full + 1):
            at, blocks = e * total, []
            for position, block, _, n in sorted(epochs[s, e], key=lambda x: (x[0], -x[3])):  # rows without tokens stand where the one before them ends
                at += n  # positions are running sums of tokens in the epoch's order, over the budget
                assert abs(position - at / budgets[s]) < 1e-9
                blocks += [block] if block not in blocks[-1:] else []
            assert len(blocks) == len(set(blocks))  # each block stands together
        assert sum(x[3] for x in epochs[s, full]) <= rest


def test_op10(spark, folder, texts):
    rows = {r.doc_id: r for r in ngram_join.op10_ngram_jaccard_join(spark, folder).collect()}
    sets = []
    for t in texts:
        w = utf8(t).lower().split() if (t or "").isascii() else utf8(t).split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    roots = ngram_join.Roots()
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                roots.join(a, b)
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == {i: (len(s), roots.find(i)) for i, s in enumerate(sets)}


def test_ids_are_little_endian():
    assert struct.unpack("<2I", encoder().ids("<|endoftext|> x")) == (50256, 2124)
