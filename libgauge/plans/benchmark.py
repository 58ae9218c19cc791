"""A benchmark run, from descriptions to summaries."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators import aggregate, score, select
from ..sources import readers, seams, sinks
from ..sources.files import write_joined
from ..store import Store

#: Seconds between requests.
DELAY = 1.0


@dataclass
class Benchmark:
    """All tables are saved: reading them again measures nothing again."""

    runs: DataFrame
    regions: DataFrame
    by_model: DataFrame
    by_model_and_region: DataFrame
    #: Descriptions and models that took part.
    counts: tuple[int, int] = (0, 0)
    files: dict[str, str] = field(default_factory=dict)
    #: Runs and failures, counted while the runs were written.
    seen: dict[str, int] = field(default_factory=dict)
    store: Store | None = None

    def close(self) -> None:
        """Delete the tables; the files that were written stay."""
        if self.store is not None:
            self.store.close()


def plan_runs(models: DataFrame, chosen: DataFrame, mode: str = "pdf") -> DataFrame:
    """Model by description, with the input that each run uses.  Whether a file is there is known if
    ``readers.with_contents`` has added the contents."""
    paired = score.pair(models.withColumnsRenamed({"name": "model_name"}), chosen)
    there = {f"{k}_there": f"{k}_there" for k in ("pdf", "text") if f"{k}_there" in chosen.columns}
    routed = select.route_input(paired, mode, **there).drop("pdf_there", "text_there")
    return routed.withColumn("input_mode", F.lit(mode)).withColumn("model_id", F.col("model"))


def evaluate(runs: DataFrame, include_raw: bool = False, store: Store | None = None) -> Benchmark:
    """Score runs that have a response or an error: distances are measured once, the scored runs are written once, and
    all that follows reads those."""
    store = store or Store(runs.sparkSession)
    typed = readers.predictions(runs)
    truth = typed.withColumnsRenamed({"library_sequence": "gt_library", "segments": "gt_segments", "placeholders": "gt_placeholders"})
    scored = score.score_runs(truth, store)
    scored = scored.withColumn("source_used", F.when(~score.failed(), F.col("source_used")).otherwise("")) if "source_used" in scored.columns else scored
    scored = scored.withColumn("prediction", F.when(~score.failed(), F.col("prediction")))
    seen = Observation()
    kept = store.save(scored if include_raw else scored.drop("raw_output"), seen, runs=F.count(F.lit(1)), failures=F.count_if(score.failed()))
    keys = [c for c in ("model_pos", "file_name") if c in kept.columns]
    regions = score.region_rows(kept, *keys, "protocol_id", "model_name")
    summaries = store.save(aggregate.by_model(kept)), store.save(aggregate.by_model_and_region(regions.drop(*keys)))
    return Benchmark(kept, regions, *summaries, seen=dict(seen.get), store=store)


def run(
    models: DataFrame, protocols: DataFrame, transport: seams.Transport, mode: str = "pdf", limit: int | None = None, delay: float = 0.0, ids: list[str] | None = None,
    include_raw: bool = False, contents: tuple[DataFrame, DataFrame] | None = None, requests_at_once: int | None = None, journal: str | None = None,
) -> Benchmark:
    """Ask every model about every chosen description.  ``contents`` are the PDFs (path, content) and texts
    (path, value) that are there; without them paths are taken as they stand.  They are joined to the requests last, file
    by file.  Replies are kept in the shared folder, and with a ``journal`` (a folder) one by one as they
    come, so that a run that is begun again only sends what has no reply yet."""
    chosen = select.choose(protocols, ids, limit)
    counts = (chosen.count(), models.count())
    if contents is not None:
        chosen = readers.with_presence(chosen, *contents)
    store = Store(models.sparkSession)
    planned = store.save(plan_runs(models, chosen, mode))
    if contents is not None:  # only those of kinds that the mode sends
        contents = tuple(files if mode in (kind, "auto") else files.limit(0) for kind, files in zip(("pdf", "text"), contents))
    replies = store.save(seams.infer(planned, transport, delay, requests_at_once, journal or f"{store.root}/journal", None if mode == "url" else contents))
    result = evaluate(replies, include_raw, store)
    result.counts = counts
    return result


def run_folder(
    spark: SparkSession, models_file: str, root: str, output_dir: str, protocol_dir: str = "protocols", text_dir: str = "protocol_texts", mode: str = "pdf", ids: list[str] | None = None, limit: int | None = None,
    delay: float = DELAY, timeout: float = 360.0, include_raw: bool = False, transport: seams.Transport | None = None, requests_at_once: int | None = None, journal: str | None = None,
) -> Benchmark:
    """The whole program: read a folder of descriptions, ask, score, and write the JSON document and the two CSV
    files, each one file, under names with the time of the start."""
    started = datetime.now(UTC)
    protocols = readers.load_protocols(spark, root, protocol_dir, text_dir)
    pdfs = readers.read_binaries(spark, root, recursive=True)
    texts = readers.read_texts(spark, f"{root.rstrip('/')}/{text_dir}") if not readers.listing(spark, f"{root.rstrip('/')}/{text_dir}").isEmpty() else spark.createDataFrame([], "file_name string, path string, value string")
    models = readers.models(spark, models_file)
    result = run(models, protocols, transport or seams.http_transport(timeout), mode, limit, delay, ids, include_raw, (pdfs, texts), requests_at_once, journal)
    mark = spark.range(1).select(sinks.stamp(F.lit(started))).first()[0]
    names = {"json": f"benchmark-{mark}.json", "runs": f"benchmark-runs-{mark}.csv", "regions": f"benchmark-regions-{mark}.csv"}
    result.files = {k: f"{output_dir.rstrip('/')}/{n}" for k, n in names.items()}
    whole = sinks.envelope(result.runs, result.regions, result.by_model, result.by_model_and_region, result.counts, started.isoformat(), datetime.now(UTC).isoformat(), mode, models_file)
    write_joined(whole, result.files["json"])
    sinks.write_csv(result.runs, sinks.RUN_COLUMNS, result.files["runs"], ("model_pos", "file_name"))
    sinks.write_csv(result.regions, sinks.REGION_COLUMNS, result.files["regions"], ("model_pos", "file_name", "segment_index"))
    return result
