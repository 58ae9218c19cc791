"""Mixing sources by temperature, realised as budgeted block permutations.

Source token shares p are raised to an exponent: weights w ~ p ** a.  The exponent is found by
bisection between 0 (all sources alike) and 1 (as they are): the least one whose most repeated
source is read no more than ``repetition_limit`` times, or the one whose weights have the entropy
``target_entropy`` (nats).  Without ``budget_tokens`` the budget is the least that reads every
source at least once, so that no document is lost.

A source's budget is a run of epochs.  In each epoch its rows, dealt into blocks of about
BLOCK_ROWS by a hash, stand in an order of their own: blocks permuted, rows permuted inside blocks.
The last epoch ends where its tokens reach the budget.  Positions come from sums of blocks and sums
inside a block, so no source is ever brought to one task, however large.

Blocks and orders come from hashes of the rows' columns, and from numbers among rows that are alike in all
of them, so the draws don't depend on how rows are dealt out.

Tokens are ids of the public vocabulary (``tokens.py``).

Defined results: a null source is a source of its own (named by null); null and empty texts have 0
tokens and are read in every full epoch and in the last one if they come before its end; sources
without tokens are read once; repeated rows are drawn each on its own; an empty table gives an empty
result; other columns are ignored by ``draw`` and kept by ``mix``.  More than MAX_SOURCES sources
are refused: their totals are the only thing brought to the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Workspace, fresh, row_marks
from .tokens import count_tokens

BLOCK_ROWS = 4096
MAX_SOURCES = 100_000
REPETITION_LIMIT = 1.5


def temperature_weights(tokens: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised weights; sources without tokens have weight 0."""
    share = np.where(tokens > 0, tokens, 1) / max(1, tokens.sum())
    raw = np.where(tokens > 0, share**exponent, 0.0)
    return raw / raw.sum() if raw.sum() else raw


def cover_budget(tokens: np.ndarray, weights: np.ndarray) -> float:
    """The least budget that reads each source once."""
    has = weights > 0
    return float((tokens[has] / weights[has]).max()) if has.any() else 0.0


def find_exponent(tokens: np.ndarray, repetition_limit: float | None = REPETITION_LIMIT, target_entropy: float | None = None, budget_tokens: float | None = None, steps: int = 60) -> float:
    """Bisect the exponent in [0, 1] for one of the two targets."""

    def flat_enough(a: float) -> bool:
        w = temperature_weights(tokens, a)
        if target_entropy is not None:
            return -(w[w > 0] * np.log(w[w > 0])).sum() <= target_entropy
        budget = budget_tokens if budget_tokens is not None else cover_budget(tokens, w)
        has = w > 0
        return not has.any() or (w[has] * budget / tokens[has]).max() <= repetition_limit

    low, high = 0.0, 1.0
    if flat_enough(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if flat_enough(middle) else (middle, high)
    return high


def budgets(names: list, tokens: list[int], **target) -> list[tuple]:
    """(source, tokens, weight, token budget, full epochs, tokens of the last epoch)."""
    t = np.array(tokens, float)
    weights = temperature_weights(t, find_exponent(t, **target))
    total = target.get("budget_tokens")
    total = cover_budget(t, weights) if total is None else float(total)
    out = []
    for name, n, w in zip(names, tokens, weights):
        budget = math.floor(w * total + 0.5 + 1e-6)
        full, rest = divmod(budget, n) if n else (1, 0)
        out.append((name, n, float(w), budget, full, rest))
    return out


def among_copies(rows: DataFrame) -> DataFrame:
    """Rows (rid, mark1, mark2, ...) with ``copy``, from 0 among rows of the same marks.  Copies are numbered inside the
    partitions that rid tells, and these by their counts, so that many copies don't meet in one task."""
    placed = rows.withColumn("part", F.shiftright("rid", 33))
    counts = placed.groupBy("mark1", "mark2", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("mark1", "mark2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = counts.withColumn("before", before).filter("before IS NOT NULL").select("mark1", "mark2", "part", "before")
    inside = F.row_number().over(Window.partitionBy("mark1", "mark2", "part").orderBy("rid")) - 1
    return placed.withColumn("inside", inside).join(later, ["mark1", "mark2", "part"], "left").withColumn("copy", F.col("inside") + F.coalesce("before", F.lit(0))).drop("part", "inside", "before")


def draw(rows: DataFrame, seed: int = 17, **target) -> DataFrame:
    """Rows (rid, source, tokens, marks) to draws: rid, source, tokens, epoch, block, position in [0, 1].  Marks are two
    hashes of what a row says; without them its rid is all it says."""
    spark = rows.sparkSession
    if "mark1" not in rows.columns:
        rows = rows.withColumns({"mark1": F.xxhash64("rid"), "mark2": F.col("rid")})
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    blocks_of = {r["source"]: -(-r["n"] // BLOCK_ROWS) for r in sums}
    plan = [(*b, blocks_of[b[0]]) for b in budgets([r["source"] for r in sums], [r["tokens"] for r in sums], **target)]
    plan_df = spark.createDataFrame(plan, "source string, source_tokens long, weight double, budget long, full int, rest long, blocks long")
    plan_df = F.broadcast(plan_df)  # MAX_SOURCES rows at most
    own = ("mark1", "mark2", "copy")
    placed = among_copies(rows)
    dealt = placed.join(plan_df, placed["source"].eqNullSafe(plan_df["source"])).select("rid", *own, placed["source"], "tokens", "source_tokens", "budget", "full", "rest", F.pmod(F.xxhash64(*own, F.lit(seed)), "blocks").alias("block"))
    block_sums = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("full").alias("full"))
    epochs = lambda: F.explode(F.sequence(F.lit(0), F.col("full"))).alias("epoch")
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("epoch", "block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = block_sums.select("source", "block", "block_tokens", epochs()).withColumn("before", F.coalesce(F.sum("block_tokens").over(order), F.lit(0))).drop("block_tokens")
    inside = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(*own, "epoch", F.lit(seed)), *own).rowsBetween(Window.unboundedPreceding, 0)
    spread = dealt.select("*", epochs()).withColumn("upto", F.sum("tokens").over(inside))
    same = spread["source"].eqNullSafe(before["source"]) & (spread["epoch"] == before["epoch"]) & (spread["block"] == before["block"])
    placed = spread.join(before, same).select("rid", spread["source"], "tokens", spread["epoch"], spread["block"], (F.col("before") + F.col("upto")).alias("upto"), "source_tokens", "budget", spread["full"], "rest")
    drawn = placed.filter((F.col("epoch") < F.col("full")) | (F.col("upto") <= F.col("rest")) & (F.col("rest") > 0))
    position = F.when(F.col("budget") > 0, (F.col("epoch") * F.col("source_tokens") + F.col("upto")) / F.col("budget")).otherwise(F.lit(0.0))
    return drawn.select("rid", "source", "tokens", F.col("epoch").cast("int").alias("epoch"), "block", position.alias("position"))


def mix(df: DataFrame, source_col: str = "source", text_col: str = "text", **target) -> DataFrame:
    """The rows of ``df`` as often as drawn, all columns kept, in no particular order."""
    work = Workspace(df.sparkSession, "mixing")
    rid, first, second, tokens, drawn, times, copy = fresh(df.columns, "rid", "mark1", "mark2", "tokens", "drawn", "times", "copy")
    numbered = df.withColumns(dict(zip((rid, first, second), (F.monotonically_increasing_id(), *row_marks(df)))))
    numbered = work.save(count_tokens(numbered, [*df.columns, rid, first, second], text_col, tokens), "rows")
    slim = numbered.select(F.col(rid).alias("rid"), F.col(first).alias("mark1"), F.col(second).alias("mark2"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(tokens).alias("tokens"))
    often = draw(slim, **target).groupBy(F.col("rid").alias(drawn)).agg(F.count(F.lit(1)).cast("int").alias(times))
    again = numbered.join(often, F.col(rid) == F.col(drawn)).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return again.select(*(F.col(f"`{c}`") for c in df.columns))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    work = Workspace(spark, "mixing")
    marked = docs.withColumns(dict(zip(("rid", "mark1", "mark2"), (F.monotonically_increasing_id(), *row_marks(docs)))))
    rows = work.save(count_tokens(marked, ["rid", "mark1", "mark2", "doc_id", "source"], "text", "tokens"), "rows")
    drawn = draw(rows.select("rid", "mark1", "mark2", "source", "tokens"))
    return drawn.join(rows.select("rid", "doc_id"), "rid").select("doc_id", "source", "tokens", "epoch", "block", "position")
