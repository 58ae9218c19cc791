"""Summaries: one pass by model, one by model and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .score import failed


def mean(x: Column, where: Column | None = None) -> Column:
    """Arithmetic mean as a double; 0 for no values."""
    value = x.cast("double")
    return F.coalesce(F.avg(value if where is None else F.when(where, value)), F.lit(0.0))


def rate(x: Column, where: Column | None = None) -> Column:
    return mean(x.cast("int"), where)


def by_model(scored: DataFrame, *keys: str) -> DataFrame:
    """Means over successes, the duration over all runs."""
    ok = ~failed()
    return scored.groupBy(*(keys or ("model_name",))).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        mean(F.col("library_similarity"), ok).alias("avg_library_similarity"), rate(F.col("library_exact"), ok).alias("library_exact_rate"),
        mean(F.col("ordered_region_accuracy"), ok).alias("avg_ordered_region_accuracy"), mean(F.col("ordered_sequence_accuracy"), ok).alias("avg_ordered_sequence_accuracy"),
        mean(F.col("duration_seconds")).alias("avg_duration_seconds"),
    )


def by_model_and_region(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model_name", "region").agg(
        F.count(F.lit(1)).alias("count"), rate(F.col("region_exact")).alias("region_exact_rate"), rate(F.col("sequence_exact")).alias("sequence_exact_rate"),
        mean(F.col("sequence_similarity")).alias("avg_sequence_similarity"), rate(F.col("length_exact")).alias("length_exact_rate"),
        rate(F.col("char_exact"), F.col("char_exact").isNotNull()).alias("char_exact_rate"),
    )


def region_labels(summary: DataFrame) -> DataFrame:
    """The label model::region and what comes out when it is split at its first ``::``."""
    label = F.concat_ws("::", "model_name", "region")
    return summary.withColumn("label", label).withColumn("label_model", F.split(label, "::", 2)[0]).withColumn("label_region", F.split(label, "::", 2)[1])


def failures_as_zero(scored: DataFrame) -> DataFrame:
    """Not in the reference: mean similarity with failed runs counted as 0."""
    return scored.groupBy("model_name").agg(mean(F.when(failed(), F.lit(0.0)).otherwise(F.col("library_similarity"))).alias("similarity_with_failures"))


def consistency(protocols: DataFrame) -> DataFrame:
    """Not in the reference: does a truth document agree with itself?"""
    joined = F.array_join(F.transform("segments", lambda s: s["sequence"]), "")
    return protocols.select("protocol_id", (joined == F.col("library_sequence")).alias("segments_make_library"), F.forall("segments", lambda s: F.coalesce(s["length"] == F.length(s["sequence"]), F.lit(True))).alias("lengths_hold"))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def join_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """Non-blank pages (page, text) joined in order, each under a header with its own number."""
    from ..functions.text import strip

    shown = pages.filter(strip(F.col("text")) != "").select(*keys, F.struct("page", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text")).alias("shown")).alias("one"))
    return shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda p: p["shown"]), "\n\n").alias("text"))
