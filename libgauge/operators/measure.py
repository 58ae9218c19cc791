"""Edit distances of whole tables of runs: each pair of texts once, dealt to tasks of equal cost.

A run's texts are its libraries and, at each place, the truth's and the predicted segment.  Runs are
exploded into these pairs, so that a run of ten thousand segments isn't one task's work.  Pairs that
bands settle end there; of the others each distinct pair is measured once, wherever it occurs, and tasks get
them by cost, the dearest first.  Only numbers go back to the runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distance import banded, cost, far
from ..store import Store, unused
from .number import deal_by_cost


def tasks_of(rows: DataFrame) -> int:
    """Four for each core, and no fewer than the session's shuffle partitions, which grow with the data."""
    spark = rows.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pair_key(left: Column, right: Column) -> Column:
    """What a pair of texts is known by."""
    return F.unhex(F.sha2(F.concat(F.length(left).cast("string"), F.lit(":"), left, right), 256))


def measure_pairs(pairs: DataFrame, store: Store, tasks: int | None = None) -> DataFrame:
    """Distinct pairs (left, right) that bands have not settled, as key, distance."""
    dealt = deal_by_cost(pairs.select("left", "right").distinct(), cost(F.col("left"), F.col("right")), tasks or tasks_of(pairs))
    left, right = F.col("left"), F.col("right")
    return store.save(dealt.select(pair_key(left, right).alias("key"), far(left, right, F.lit(None).cast("int")).alias("distance")))


def distances(rows: DataFrame, texts: Column, name: str, store: Store, tasks: int | None = None) -> DataFrame:
    """Rows, saved, with ``name``: the distances of the pairs in the array ``texts`` (struct left, right), in its order; an
    empty array for none."""
    (row,) = unused([*rows.columns, name], "row")
    kept = store.save(rows.withColumn(row, F.monotonically_increasing_id()))
    exploded = kept.select(F.col(row).alias("row"), F.posexplode(texts).alias("place", "pair")).select("row", "place", F.col("pair.left").alias("left"), F.col("pair.right").alias("right"))
    left, right = F.col("left"), F.col("right")
    near = exploded.withColumn("near", banded(left, right))
    open_ = lambda x: F.when(F.col("near").isNull(), x)
    pieces = store.save(near.select("row", "place", "near", open_(pair_key(left, right)).alias("key"), open_(left).alias("left"), open_(right).alias("right")))
    measured = measure_pairs(pieces.filter("near IS NULL"), store, tasks)
    told = pieces.select("row", "place", "near", "key").join(measured, "key", "left").select("row", "place", F.coalesce("near", "distance").alias("distance"))
    whole = told.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "distance"))), lambda p: p["distance"]).alias(name))
    back = kept.join(whole.withColumnRenamed("row", row), row, "left")
    return back.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<int>"))).drop(row)


def run_texts(truth: Column, predicted: Column, gt_library: Column, pred_library: Column, library: bool = True, segments: bool = True) -> Column:
    """array<struct<left, right>>: the libraries, then each truth segment's sequence and the predicted one's at its place;
    without ``library`` or ``segments`` only the others."""
    text = lambda x: F.coalesce(x, F.lit(""))
    pair = lambda a, b: F.struct(text(a).alias("left"), text(b).alias("right"))
    parts = [F.array(pair(gt_library, pred_library))] if library else []
    parts += [F.transform(truth, lambda g, i: pair(g["sequence"], F.get(predicted, i)["sequence"]))] if segments else []
    return F.concat(*parts)
