"""Conversation repair against a search over all edits by cost and letters."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from libgauge.llm import turn_repair
from libgauge.llm.turn_repair import Costs, Determiniser, damaged, repair, typed

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def slow_damage(rows):
    shown = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if kind:
            yield from [(conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)


def slow(rows, costs=Costs()):
    """One conversation's numbers, by a search of the cheapest and then least edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, k, state, written = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            break
        for role in ("user", "assistant"):
            if (state, role[0]) in AFTER:
                heapq.heappush(heap, (cost + costs.insert, letters + "I", k, role[0], (*written, f"{role}:")))
        if k < len(rows):
            _, _, role, text = rows[k]
            heapq.heappush(heap, (cost + costs.delete, letters + "D", k + 1, state, written))
            if faults[k] not in ("blank", "duplicate"):
                more = costs.truncated if faults[k] else 0
                for letter, as_, price in (("K", role, costs.keep), ("R", "user", costs.rerole), ("R", "assistant", costs.rerole)):
                    if (state, as_[:1]) in AFTER:
                        heapq.heappush(heap, (cost + price + more, letters + letter, k + 1, as_[0], (*written, f"{as_}:{text}")))
    turns = [r[1] for r in rows if r[1] is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, letters, hashlib.sha256("\n".join(written).encode()).hexdigest(),
    )


def made():
    rng = random.Random(8)
    texts = ["Yes.", "No", "why?", "", " \n", "é!", "a. b", None, "end. \t", "x" * 5000 + "."]
    rows = [(c, t, rng.choice(("user", "assistant", "assistant", "user", "system", "tool", "", None)), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(9)}.") for c in range(120) for t in range(rng.randrange(1, 9))]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" + "." * (t % 7 > 0)) for t in range(3000)]  # a long one
    rows += [(501, t, "assistant", "same.") for t in range(400)] + [(502, 3, "user", "again.")] * 50 + [(None, None, None, None), (None, 2, "user", "a."), (503, None, "user", "b."), (503, -5, "assistant", "b."), (503, 1 << 40, "user", "c.")]
    rows += [(504, 1, r, t) for r in ("user", "assistant") for t in ("p.", "q.", "p.")]  # ties
    rows += [(600 + k, 0, "user", "one") for k in range(60)]  # some lose their only row
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame(made(), "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("kind", "mark", "copies", "blank", "cut")}).repartition(6).write.parquet(f"{d}/conversations.parquet")
    return d


def grouped(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return groups


def test_every_conversation(spark, folder):
    left = grouped(slow_damage(made()))
    got = {r[0]: tuple(r)[1:] for r in turn_repair.op13_turn_repair(spark, folder).collect()}
    assert got.keys() == {r[0] for r in made()} and len(left) < len(got)
    for conv, numbers in got.items():
        assert numbers == slow(left.get(conv, [])), conv
    assert {x for n in got.values() for x in n[6]} == set("DKR")  # at these costs a deletion always beats an insertion


def test_as_they_are(spark, folder):
    rows = typed(spark.read.parquet(f"{folder}/conversations.parquet"))
    want = {c: slow([(c, t, " " if r is None else r, " " if x is None else x) for _, t, r, x in g]) for c, g in grouped(made()).items()}
    assert {r[0]: tuple(r)[1:] for r in repair(rows).collect()} == want


def test_other_costs(spark, folder):
    costs = Costs(keep=1, rerole=3, delete=3, insert=1, truncated=1)
    rows = typed(spark.read.parquet(f"{folder}/conversations.parquet"))
    got = {r[0]: tuple(r)[1:] for r in repair(damaged(rows), rows, costs).collect()}
    left = grouped(slow_damage(made()))
    assert got == {c: slow(left.get(c, []), costs) for c in got} and {x for n in got.values() for x in n[6]} == set("DIKR")


def test_layout_does_not_matter(spark, folder):
    rows = typed(spark.read.parquet(f"{folder}/conversations.parquet"))
    one, seven = (sorted(map(str, repair(damaged(rows.repartition(n)), rows).collect())) for n in (1, 7))
    assert one == seven


def test_no_rows(spark, folder):
    rows = typed(spark.read.parquet(f"{folder}/conversations.parquet"))
    assert repair(rows.limit(0)).count() == 0
    (gone,) = repair(rows.limit(0), spark.createDataFrame([(9,)], "conv_id long")).collect()
    assert tuple(gone) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_few_states():
    automaton, rng = Determiniser(), random.Random(1)
    for _ in range(2000):
        automaton.scan(bytes(rng.randrange(turn_repair.SYMBOLS) for _ in range(40)))
    assert len(automaton.vectors) < 100
