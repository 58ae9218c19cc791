"""Row numbers in a global order, and rows dealt by what they cost, without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..store import saved, unused


def number_rows(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``name`` from 1 in the given order.  Rows are sorted by ranges over all tasks; only the ranges' row
    counts, one a partition, meet in one place."""
    part, place, before = unused([*rows.columns, name], "part", "place", "before")
    kept = saved(rows.orderBy(*order).withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)))
    counts = kept.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    inside = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), part).withColumn(name, (F.col(before) + inside + 1).cast("long")).drop(part, place, before)


def deal_by_cost(rows: DataFrame, cost: Column, tasks: int) -> DataFrame:
    """Rows in ``tasks`` partitions of about equal cost: the dearest first, they are dealt out one by one, forth and
    back, so that two tasks differ by no more than the dearest row's cost."""
    price, number = unused(rows.columns, "price", "number")
    numbered = number_rows(rows.withColumn(price, cost), number, F.desc(price))
    at = F.pmod(F.col(number) - 1, F.lit(2 * tasks))
    to = F.when(at < tasks, at).otherwise(2 * tasks - 1 - at)
    return numbered.repartitionById(tasks, to.cast("int")).drop(price, number)
