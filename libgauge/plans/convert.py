"""The programs beside the benchmark: PDFs to texts, OCR, downloads.  Each does its work once, keeps what
became of every file in the shared folder, and gives that back as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import newline_count, path_name, path_stem
from ..operators import aggregate
from ..sources import acquire, readers, seams, sinks
from ..store import saved

Put = Callable[[str, bytes], None]


def _target(folder: str):
    return F.concat(F.lit(folder.rstrip("/") + "/"), path_stem(F.col("path")), F.lit(".txt"))


def pdf_to_text(spark: SparkSession, input_dir: str, output_dir: str, file: str | None = None, read: Callable[[bytes], Iterable[str]] = seams.pdf_pages, put: Put = acquire.replace_file) -> DataFrame:
    """path, target, text, message in path order: the non-blank pages of each PDF under their numbers.  A PDF
    without text gives an empty file."""
    pdfs = readers.pdf_files(spark, input_dir, file)
    seams.register_page_reader(spark, read)
    pdfs.createOrReplaceTempView("libgauge_pdfs")
    pages = spark.sql("SELECT path, p.page, p.text FROM libgauge_pdfs, LATERAL pages_of(content) p")
    texts = pdfs.select("path").join(aggregate.join_pages(pages, "path"), "path", "left").select("path", _target(output_dir).alias("target"), F.coalesce("text", F.lit("")).alias("text"))
    written = saved(sinks.write_texts(texts, put))
    message = F.concat(F.lit("  "), path_name(F.col("path")), F.lit(" → "), path_name(F.col("target")), F.lit(" ("), sinks.thousands(F.length("text")), F.lit(" chars, "), sinks.thousands(newline_count(F.col("text"))), F.lit(" lines)"))
    return written.withColumn("message", message).orderBy("path")


def run_ocr(spark: SparkSession, input_dir: str, output_dir: str, load: Callable[[], Callable[[bytes], str]] | None = None, file: str | None = None, overwrite: bool = False, put: Put = acquire.replace_file, split: Callable[[bytes], Iterable[bytes]] | None = None) -> DataFrame:
    """path, target, status (converted, skipped, failed), message in path order.  With ``split`` PDFs are read page by page.  PDFs whose text is there are
    skipped without ``overwrite``; a recogniser's error fails its PDF alone; texts end with a newline, and
    an empty text gives an empty file."""
    pdfs = readers.pdf_files(spark, input_dir, file)
    there = readers.listing(spark, output_dir, "*.txt").select(F.col("path").alias("target"), F.lit(True).alias("there"))
    planned = pdfs.select("path", readers.plain_path(_target(output_dir)).alias("target")).join(there, "target", "left")
    skips = F.coalesce("there", F.lit(False)) & F.lit(not overwrite)
    todo = planned.filter(~skips).select("path", "target")
    said = seams.ocr(pdfs.join(todo, "path", "left_semi"), load or seams.doctr_recogniser(), split).join(todo, "path")
    done = saved(said)
    good = done.filter("error IS NULL").select("path", "target", F.concat("text", F.when(F.col("text") != "", "\n").otherwise("")).alias("text"))
    written = saved(sinks.write_texts(good, put))
    name = path_name(F.col("path"))
    chars = sinks.thousands(F.length(F.regexp_replace("text", "\n$", "")))
    converted = written.select("path", "target", F.lit("converted").alias("status"), F.concat(name, F.lit(": wrote "), path_name(F.col("target")), F.lit(" ("), chars, F.lit(" chars)")).alias("message"))
    skipped = planned.filter(skips).select("path", "target", F.lit("skipped").alias("status"), F.concat(name, F.lit(": "), path_name(F.col("target")), F.lit(" already exists")).alias("message"))
    failed = done.filter("error IS NOT NULL").select("path", "target", F.lit("failed").alias("status"), F.concat(name, F.lit(": OCR failed ("), "error", F.lit(")")).alias("message"))
    return saved(converted.unionByName(skipped).unionByName(failed)).orderBy("path")


def download(spark: SparkSession, protocol_dir: str, output_dir: str, overwrite: bool = False, timeout: float = 60.0, get: Callable | None = None, put: Put = acquire.replace_file, remove: Callable[[str], None] = acquire.remove_file) -> DataFrame:
    """protocol_id, target, status (downloaded, skipped, error), message for every description and issue.
    Paths in descriptions are taken from the folder above theirs."""
    readers.require_folder(spark, protocol_dir, "Protocol directory does not exist")
    root = protocol_dir.rstrip("/").rpartition("/")[0]
    plan = readers.download_plan(readers.read_json_files(spark, protocol_dir, strict=False))
    named = plan.filter("issue IS NULL AND target_path IS NOT NULL").select(acquire.own_target(F.col("target_path"), root).alias("path"))
    files = readers.listing(spark, output_dir).unionByName(readers.listing_below(spark, root).join(named.distinct(), "path", "left_semi")).distinct()
    planned = acquire.pending(acquire.plan_targets(plan.filter("issue IS NULL"), files, root, output_dir), overwrite)
    fetched = seams.fetch(planned.filter("status IS NULL").drop("status", "message"), get or seams.http_getter(timeout))
    stored = acquire.store(acquire.final_targets(fetched, root, output_dir), put, remove, overwrite)
    skipped = planned.filter("status IS NOT NULL").select("protocol_id", "target", "status", "message")
    issues = plan.filter("issue IS NOT NULL").select("protocol_id", F.lit(None).cast("string").alias("target"), F.lit("error").alias("status"), F.concat("file_name", F.lit(": "), "issue").alias("message"))
    return saved(stored.unionByName(skipped).unionByName(issues))


def summary(outcome: DataFrame, *statuses: str) -> tuple[str, int]:
    """The closing line with the count of each status, and the exit code: 1 if any failed."""
    n = {r["status"]: r["n"] for r in aggregate.status_counts(outcome).collect()}
    return "Summary: " + " ".join(f"{s}={n.get(s, 0)}" if s != "error" else f"errors={n.get(s, 0)}" for s in statuses), int(bool(n.get("error", 0) + n.get("failed", 0)))
