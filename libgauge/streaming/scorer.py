"""Scoring a growing folder of predictions.  Not in the reference: alignment needs no state, so the
same scoring runs on a stream without watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import score_runs
from ..sources.readers import predictions

PREDICTIONS = "model_name string, protocol_id string, response string, error string, duration_seconds double"


def score_stream(spark: SparkSession, folder: str, truth: DataFrame) -> DataFrame:
    """Predictions (JSON lines of PREDICTIONS) joined with truth and scored."""
    arriving = predictions(spark.readStream.schema(PREDICTIONS).json(folder))
    known = truth.select("protocol_id", F.col("library_sequence").alias("gt_library"), F.col("segments").alias("gt_segments"), F.col("placeholders").alias("gt_placeholders"))
    return score_runs(arriving.join(known, "protocol_id"))


def score_available(spark: SparkSession, folder: str, truth: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Score what has arrived since the last call and stop."""
    scored = score_stream(spark, folder, truth).drop("aligned", "gt_segments", "pred_segments")
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
