"""Conversation structure repair by lazy weighted determinisation.

A repaired conversation's role initials read ``(s?(ua)+)?``.  The cheapest edits that get there are a
shortest path in a small weighted automaton: its states say what has been written so far (nothing,
a system row, a user row, an assistant row), a row of the conversation is a symbol, and each edit (keep,
rerole, delete; insertions between rows) is an arc with a cost.  The automaton is nondeterministic.  It is
determinised as rows come: the costs to the end from each state, less their minimum, are one state of the
deterministic automaton, kept in a transition table when it is first met.  Insertions bound the
differences of such a vector, so there are few (a few dozen), and a scan is one look-up a row.

The scan runs from the last row to the first, so its vectors are costs to go.  The trace then runs back
over the scanned states, first row to last, and takes at each row the tight arc of the least letter:
that gives the ASCII-least of the cheapest edit sequences, as no cheapest sequence is the beginning of another.
Traces of a (table entry, state) pair are kept too.

Rows of a conversation come to its task in order, twice: first a small digest of each row, for the scan (a byte
and a table entry's number a row are kept), then the texts, for the trace, which hashes them as they
pass.  So a conversation of any length is streamed, never held; its hash, one SHA-256 of the whole repair,
is why its rows meet in one task.  Which rows repeat an earlier one is found beforehand, by role and
text, where copies are counted before they move.

Defined results: a null role or text is one space; rows stand by turn (null first), then role, then the hash of the
text, so repeated rows are kept in a fixed order; rows with a null conversation id form one
conversation; a conversation all of whose rows were dropped has zeros, no edits and the hash of the
empty string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, rows_out



class Costs(NamedTuple):
    """What edits cost; a truncated row that isn't deleted adds its own.  Inserting must cost something."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


SPACE = " \t\n\v\f\r"
#: States: nothing written, and the last row written is a system, user or assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or reroled row leads to, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What a kept row leads to, by state and initial; others can't be kept there.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INITIALS = "sua?"
SOUND, CUT, BAD = range(3)
#: A symbol is an initial and a fault.
SYMBOLS = 3 * len(INITIALS)
LEGAL = {"su", "ua", "au"}


def symbol(role: str, fault: int) -> int:
    return 3 * (INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else 3) + fault


class Determiniser:
    """The deterministic automaton, built as far as conversations need it."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.arcs: list[int] = []  # state * SYMBOLS + symbol to the next state, -1 where not built yet
        self.added: list[int] = []
        self.traces: dict[tuple[int, int], tuple[str, int]] = {}
        to_end = self._inserted([0, 2 * costs.insert, costs.insert, 0])
        self.start, self.offset = self._number(to_end), min(to_end)

    def _number(self, costs: list[int]) -> int:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.arcs += [-1] * SYMBOLS
            self.added += [0] * SYMBOLS
        return self.numbers[vector]

    def _inserted(self, costs: list[int]) -> list[int]:
        for _ in costs:
            costs = [min(c, self.costs.insert + costs[NEXT[q]]) for q, c in enumerate(costs)]
        return costs

    def edits(self, state: int, sign: int) -> Iterator[tuple[str, int, int]]:
        """(letter, next state, cost) of the edits that take a row, least letter first."""
        initial, fault = INITIALS[sign // 3], sign % 3
        yield "D", state, self.costs.delete
        if fault != BAD:
            more = self.costs.truncated if fault == CUT else 0
            if (state, initial) in KEPT:
                yield "K", KEPT[state, initial], self.costs.keep + more
            yield "R", NEXT[state], self.costs.rerole + more

    def arc(self, state: int, sign: int) -> int:
        """Build a table entry: the vector before a row from the one behind it."""
        behind = self.vectors[state]
        costs = self._inserted([min(c + behind[q] for _, q, c in self.edits(p, sign)) for p in range(4)])
        at = state * SYMBOLS + sign
        self.arcs[at], self.added[at] = self._number(costs), min(costs)
        return self.arcs[at]

    def scan(self, symbols: bytes) -> tuple[int, array]:
        """The cost of a conversation, and the state behind each row (in order)."""
        states, now, cost = array("H", bytes(2 * len(symbols))), self.start, self.offset
        for k in range(len(symbols) - 1, -1, -1):
            states[k] = now
            at = now * SYMBOLS + symbols[k]
            now = self.arcs[at] if self.arcs[at] >= 0 else self.arc(now, symbols[k])
            cost += self.added[at]
        return cost + self.vectors[now][NOTHING], states

    def trace(self, behind: int, sign: int, state: int) -> tuple[str, int]:
        """The letters up to and with a row's own, least first among tight arcs, and the state then."""
        key = (behind * SYMBOLS + sign, state)
        if key not in self.traces:
            at, letters = state, ""
            after, before, added = self.vectors[behind], self.vectors[self.arcs[key[0]]], self.added[key[0]]
            while not letters or letters[-1] == "I":
                delete, *rest = self.edits(at, sign)
                arcs = [(*delete, after), ("I", NEXT[at], self.costs.insert, None), *((*edit, after) for edit in rest)]
                for letter, to, cost, values in arcs:
                    ahead = before[to] + added if values is None else values[to]
                    if cost + ahead == before[at] + added:
                        letters, at = letters + letter, to
                        break
            self.traces[key] = letters, at
        return self.traces[key]

    def end(self, state: int) -> str:
        """The insertions after the last row."""
        return {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


class Repair:
    """One conversation: digests in order, then texts in order."""

    def __init__(self, automaton: Determiniser):
        self.automaton = automaton
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last = None
        self.turns = 0
        self.initial: str | None = None
        self.fresh = None  # (turn, role, mark) of the row that is not a repetition
        self.states: array | None = None

    def digest(self, turn: int | None, role: str, mark: bytes, blank: bool, cut: bool, copies: int, first: bool) -> None:
        """``first`` announces that the next digest has the first row of its role and text."""
        if first:
            self.fresh = (turn, role, mark)
            return
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        self.initial = initial
        if blank:
            self.blank += copies
        else:
            new = (turn, role, mark) == self.fresh
            self.truncated += new and cut
            self.duplicate += copies - new
            if new:
                self.symbols.append(symbol(role, CUT if cut else SOUND))
                copies -= 1
        self.symbols += bytes([symbol(role, BAD)]) * copies

    def scanned(self) -> None:
        """After the last digest."""
        if self.states is None:
            self.cost, self.states = self.automaton.scan(bytes(self.symbols))
            self.at, self.state, self.audit = 0, NOTHING, []
            self.hash, self.written = hashlib.sha256(), False

    def _write(self, role: str, text: bytes) -> None:
        self.hash.update((b"\n" if self.written else b"") + role.encode() + b":" + text)
        self.written = True

    def _inserts(self, n: int) -> None:
        for _ in range(n):
            self.state = NEXT[self.state]
            self._write(ROLE[self.state], b"")

    def _row(self, role: str = "", text: bytes = b"") -> None:
        """The next row's edits."""
        letters, after = self.automaton.trace(self.states[self.at], self.symbols[self.at], self.state)
        self.audit.append(letters)
        self.at += 1
        self._inserts(len(letters) - 1)
        if letters[-1] != "D":
            self._write(role if letters[-1] == "K" else ROLE[after], text)
        self.state = after

    def text(self, role: str, text: bytes) -> None:
        self.scanned()
        while self.symbols[self.at] % 3 == BAD:
            self._row()
        self._row(role, text)

    def finish(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        self.scanned()
        while self.at < len(self.symbols):
            self._row()
        self.audit.append(self.automaton.end(self.state))
        self._inserts(len(self.audit[-1]))
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


REPAIRED = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
REPAIRED_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: What a row that comes to a conversation's task is.
THERE, FIRST, DIGEST, TEXT = range(4)


def typed(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage, with ``copies``."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    return rows.withColumn("kind", kind).filter("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(rows: DataFrame, conversations: DataFrame | None = None, costs: Costs = Costs()) -> DataFrame:
    """REPAIRED_DDL for each conversation of ``rows`` (conv_id, turn, role, text, optional copies) and each id
    of ``conversations``."""
    bounded_batches(rows.sparkSession)
    rows = rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1).cast("long"))
    tail = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = rows.withColumns({"mark": F.unhex(F.sha2("text", 256)), "blank": tail == "", "cut": ~F.substring(tail, -1, 1).isin(".", "!", "?")})
    none: dict[str, Column] = {"turn": F.lit(None).cast("long"), "role": F.lit(""), "mark": F.lit(b""), "blank": F.lit(False), "cut": F.lit(False), "copies": F.lit(0).cast("long"), "text": F.lit(None).cast("string")}
    shape = lambda df, kind, **own: df.select("conv_id", F.lit(kind).alias("kind"), *(own.get(c, F.col(c) if c in df.columns else none[c]).alias(c) for c in none))
    digests = marked.groupBy("conv_id", "turn", "role", "mark", "blank", "cut").agg(F.sum("copies").alias("copies"))
    firsts = marked.filter("NOT blank").groupBy("conv_id", "role", "mark", "text").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("no_turn"))
    firsts = firsts.withColumn("turn", F.when(~F.col("no_turn"), F.col("least")))
    there = (conversations if conversations is not None else rows).select("conv_id").distinct()
    parts = [shape(there, THERE), shape(firsts, FIRST, text=none["text"]), shape(digests, DIGEST), shape(firsts, TEXT)]
    sent = parts[0]
    for part in parts[1:]:
        sent = sent.unionByName(part)
    # The scan's rows come before the texts; a first row's announcement before its digest.
    order = ["conv_id", F.col("kind") == TEXT, F.asc_nulls_first("turn"), "role", "mark", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            automaton, now, conv = Determiniser(costs), None, None
            for b in batches:
                columns = [b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "mark", "blank", "cut", "copies")]
                texts = b.column("text").cast(pa.binary()).to_pylist()
                for (conv_id, kind, turn, role, mark, blank, cut, copies), text in zip(zip(*columns), texts):
                    if now is None or conv_id != conv:
                        if now is not None:
                            yield (conv, *now.finish())
                        now, conv = Repair(automaton), conv_id
                    if kind == TEXT:
                        now.text(role, text)
                    elif kind != THERE:
                        now.digest(turn, role, mark, blank, cut, copies, kind == FIRST)
            if now is not None:
                yield (conv, *now.finish())

        yield from rows_out(REPAIRED, results(), size=lambda r: len(r[7]))

    return sent.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, REPAIRED_DDL)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(damaged(rows), rows)


#: DuckDB: the same costs and letters from the last row to the first, with the repair written out for each state.
OP13_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
damage AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 20 AS kind FROM keyed),
r AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM damage WHERE kind <> 0),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    lag(role) OVER w AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open_end
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (SELECT *, blank OR seen AS bad, NOT blank AND NOT seen AND open_end AS cut, left(role, 1) AS i FROM n),
steps AS (  -- from each state: costs to go, letters, and the rows written, each with a line feed before it
  SELECT conv_id, max(n) + 1 AS k, {'c': 0, 't': '', 'o': ''} AS q0, {'c': 10, 't': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS qs, {'c': 5, 't': 'I', 'o': chr(10) || 'assistant:'} AS qu, {'c': 0, 't': '', 'o': ''} AS qa FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, k, least(m0, {'c': iu.c + 5, 't': 'I' || iu.t, 'o': chr(10) || 'user:' || iu.o}), least(ms, {'c': iu.c + 5, 't': 'I' || iu.t, 'o': chr(10) || 'user:' || iu.o}), iu, least(ma, {'c': mu.c + 5, 't': 'I' || mu.t, 'o': chr(10) || 'user:' || mu.o})
  FROM (SELECT *, least(mu, {'c': ma.c + 5, 't': 'I' || ma.t, 'o': chr(10) || 'assistant:' || ma.o}) AS iu FROM (
    SELECT f.conv_id, f.k,
      least({'c': q0.c + 2, 't': 'D' || q0.t, 'o': q0.o}, {'c': qs.c + CASE WHEN bad OR i <> 's' THEN 999999 WHEN cut THEN 5 ELSE 0 END, 't': 'K' || qs.t, 'o': chr(10) || role || ':' || text || qs.o}, {'c': qu.c + CASE WHEN bad OR i <> 'u' THEN 999999 WHEN cut THEN 5 ELSE 0 END, 't': 'K' || qu.t, 'o': chr(10) || role || ':' || text || qu.o}, {'c': qu.c + CASE WHEN bad THEN 999999 WHEN cut THEN 6 ELSE 1 END, 't': 'R' || qu.t, 'o': chr(10) || 'user:' || text || qu.o}) AS m0,
      least({'c': qs.c + 2, 't': 'D' || qs.t, 'o': qs.o}, {'c': qu.c + CASE WHEN bad OR i <> 'u' THEN 999999 WHEN cut THEN 5 ELSE 0 END, 't': 'K' || qu.t, 'o': chr(10) || role || ':' || text || qu.o}, {'c': qu.c + CASE WHEN bad THEN 999999 WHEN cut THEN 6 ELSE 1 END, 't': 'R' || qu.t, 'o': chr(10) || 'user:' || text || qu.o}) AS ms,
      least({'c': qu.c + 2, 't': 'D' || qu.t, 'o': qu.o}, {'c': qa.c + CASE WHEN bad OR i <> 'a' THEN 999999 WHEN cut THEN 5 ELSE 0 END, 't': 'K' || qa.t, 'o': chr(10) || role || ':' || text || qa.o}, {'c': qa.c + CASE WHEN bad THEN 999999 WHEN cut THEN 6 ELSE 1 END, 't': 'R' || qa.t, 'o': chr(10) || 'assistant:' || text || qa.o}) AS mu,
      least({'c': qa.c + 2, 't': 'D' || qa.t, 'o': qa.o}, {'c': qu.c + CASE WHEN bad OR i <> 'u' THEN 999999 WHEN cut THEN 5 ELSE 0 END, 't': 'K' || qu.t, 'o': chr(10) || role || ':' || text || qu.o}, {'c': qu.c + CASE WHEN bad THEN 999999 WHEN cut THEN 6 ELSE 1 END, 't': 'R' || qu.t, 'o': chr(10) || 'user:' || text || qu.o}) AS ma
    FROM steps JOIN f ON f.conv_id IS NOT DISTINCT FROM steps.conv_id AND f.k = steps.k - 1))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND seen) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE k > 1 AND left(before, 1) || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(q0.c, 0)::BIGINT AS cost, coalesce(q0.t, '') AS audit, sha256(substr(coalesce(q0.o, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN steps ON steps.conv_id IS NOT DISTINCT FROM c.conv_id AND steps.k = 1
"""
