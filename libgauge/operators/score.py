"""Scoring: positional alignment without a shuffle, region rows and run rows."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distance import as_similarity
from ..functions.segments import letter, region, same_value, segment_length
from ..functions.text import similarity
from ..store import Store, unused
from .measure import distances, run_texts, tasks_of


def pair(models: DataFrame, protocols: DataFrame) -> DataFrame:
    """Every model with every protocol.  Models are a small configuration table; Spark broadcasts it if its
    size is known to be under the session's threshold, so that the protocols keep their partitions."""
    return protocols.crossJoin(models)


def spread(runs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal runs out evenly by model and description; ``measure`` deals what is dear by its cost."""
    return runs.repartition(tasks or tasks_of(runs), *(F.col(f"`{c}`") for c in ("model_name", "protocol_id")))


def align(truth: Column, predicted: Column, distances: Column | None = None, only: Collection[str] | None = None, first: int = 1) -> Column:
    """array<struct>: each truth segment scored against the predicted one at its place.  Surplus
    predicted segments are not in the result.  ``distances`` has the sequences' edit distances from element ``first``
    on; without it they are measured here.  ``only`` names the fields that are wanted; Spark would make the others too."""

    def scored(g: Column, i: Column) -> Column:
        p = F.get(predicted, i)
        there = p.isNotNull()
        gs, ps = F.coalesce(g["sequence"], F.lit("")), F.coalesce(p["sequence"], F.lit(""))
        gr, pr = region(g), region(p)
        fields = {
            "segment_index": i.cast("long"), "segment_name": F.coalesce(g["name"], F.lit("")), "region": gr, "gt_region": gr, "pred_region": pr, "region_exact": gr == pr,
            "gt_sequence": gs, "pred_sequence": ps, "gt_length": segment_length(g), "pred_length": segment_length(p), "length_exact": segment_length(g) == segment_length(p),
            "sequence_similarity": similarity(gs, ps) if distances is None else as_similarity(F.get(distances, i + first), gs, ps), "sequence_exact": gs == ps,
            "gt_char": letter(g), "pred_char": letter(p), "char_exact": F.when(gr != "known", letter(g) == letter(p)), "pred_present": there,
        }
        return F.struct(*(c.alias(n) for n, c in fields.items() if only is None or n in only))

    return F.transform(truth, scored)


def failed() -> Column:
    """A run failed if its error is neither null nor empty."""
    return F.coalesce(F.col("error"), F.lit("")) != ""


def _ratio(truth: Column, predicted: Column, flag: str) -> Column:
    """Matches over truth segments; 1 if there are none.  Only the flag is looked at, so no distance is measured."""
    n = F.size(truth)
    matches = F.size(F.filter(align(truth, predicted, only=(flag,)), lambda r: r[flag])).cast("long")
    return F.when(n == 0, F.lit(1.0)).otherwise(matches / n.cast("double"))


def score_runs(runs: DataFrame, store: Store | None = None, only: Collection[str] | None = None, library: bool = True) -> DataFrame:
    """Runs (gt_library, pred_library, gt_segments, pred_segments, gt_placeholders, pred_placeholders,
    error and any other columns) with their scores.  Failed runs have zero scores but the truth's
    lengths and counts, and no aligned segments.  With a store, edit distances are measured first and kept there
    (``measure``); without one, each row measures its own when they are read, and so it is on a stream.  ``only`` names the
    fields of aligned segments that are wanted, and without ``library`` nobody reads ``library_similarity``: what isn't
    wanted isn't measured."""
    failure, measured = unused(runs.columns, "failure", "measured")
    bad = F.col(failure)
    texts = runs.withColumn(failure, failed()).withColumn("gt_library", F.coalesce("gt_library", F.lit(""))).withColumn("pred_library", F.when(bad, F.lit("")).otherwise(F.coalesce("pred_library", F.lit(""))))
    nothing = F.array().cast(dict(texts.dtypes)["gt_segments"])
    sized = texts.withColumn("gt_segments", F.coalesce("gt_segments", nothing)).withColumn("pred_segments", F.when(bad, nothing).otherwise(F.coalesce("pred_segments", nothing)))
    truth, predicted, gt, pred = (F.col(c) for c in ("gt_segments", "pred_segments", "gt_library", "pred_library"))
    found, segments = None, only is None or "sequence_similarity" in only
    if store is not None and (library or segments):
        sized = distances(sized, F.when(~bad, run_texts(truth, predicted, gt, pred, library, segments)), measured, store)
        found = F.col(measured)
    aligned = sized.withColumn("aligned", F.when(~bad, align(truth, predicted, found if segments else None, only, int(library))))
    ok = lambda x, zero: F.when(bad, F.lit(zero)).otherwise(x)
    return aligned.withColumns({
        "library_similarity": ok(similarity(gt, pred) if found is None or not library else as_similarity(F.get(found, F.lit(0)), gt, pred), 0.0),
        "library_exact": ok(gt == pred, False),
        "gt_library_length": F.length("gt_library").cast("long"),
        "pred_library_length": F.length("pred_library").cast("long"),
        "gt_segment_count": F.size("gt_segments").cast("long"),
        "pred_segment_count": F.size("pred_segments").cast("long"),
        "segment_count_match": ok(F.size("gt_segments") == F.size("pred_segments"), False),
        "ordered_region_accuracy": ok(_ratio(truth, predicted, "region_exact"), 0.0),
        "ordered_sequence_accuracy": ok(_ratio(truth, predicted, "sequence_exact"), 0.0),
        "ordered_length_accuracy": ok(_ratio(truth, predicted, "length_exact"), 0.0),
        "placeholder_key_exact": ok(same_value(F.col("gt_placeholders"), F.col("pred_placeholders")), False),
    }).drop(failure, measured)


def region_rows(scored: DataFrame, *keys: str) -> DataFrame:
    """One row for each truth segment of each run that didn't fail.  An outer generator: for another one Spark
    infers a filter on the array's size, which would align, and so measure every distance, twice."""
    return scored.select(*keys, F.inline_outer("aligned")).filter("segment_index IS NOT NULL")
