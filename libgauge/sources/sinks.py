"""Tables, CSV projections, the JSON envelope, report lines and text files.  Spark's committer makes each
write whole or absent, and ``mode`` says what happens to what is there."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..store import unused
from .files import write_joined

# The columns of the two CSV files, in their order.
RUN_COLUMNS = (
    "protocol_id", "protocol_name", "model_name", "model_id", "api", "input_mode", "source_used", "duration_seconds", "library_similarity", "library_exact", "gt_library_length",
    "pred_library_length", "gt_segment_count", "pred_segment_count", "segment_count_match", "ordered_region_accuracy", "ordered_sequence_accuracy", "ordered_length_accuracy",
    "placeholder_key_exact", "error",
)
REGION_COLUMNS = (
    "protocol_id", "model_name", "segment_index", "segment_name", "region", "gt_region", "pred_region", "region_exact", "gt_length", "pred_length", "length_exact",
    "sequence_similarity", "sequence_exact", "gt_char", "pred_char", "char_exact", "pred_present",
)

# The fields of a result and of a region result in the JSON document, in their order.
RUN_FIELDS = (
    "protocol_id", "protocol_name", "model_name", "model_id", "api", "input_mode", "source_used", "error", "prediction_protocol_name", "library_similarity", "library_exact",
    "gt_library_length", "pred_library_length", "gt_segment_count", "pred_segment_count", "segment_count_match", "ordered_region_accuracy", "ordered_sequence_accuracy",
    "ordered_length_accuracy", "placeholder_key_exact", "prediction", "raw_output", "duration_seconds",
)
REGION_FIELDS = (
    "protocol_id", "model_name", "segment_index", "segment_name", "region", "gt_region", "pred_region", "region_exact", "gt_sequence", "pred_sequence", "gt_length",
    "pred_length", "length_exact", "sequence_similarity", "sequence_exact", "gt_char", "pred_char", "char_exact", "pred_present",
)


def plain_number(x: Column) -> Column:
    """A double's shortest digits: exponents below -4 and from 16 on are written out, others not."""
    s = x.cast("string")
    part = lambda k: F.regexp_extract(s, r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$", k)
    sign, first, rest, power = part(1), part(2), F.when(part(3) == "0", "").otherwise(part(3)), part(4).try_cast("int")
    tail = F.when(power < 0, F.concat(F.lit("e-"), F.lpad((-power).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("e+"), F.lpad(power.cast("string"), 2, "0")))
    small = F.concat(F.lit("0.000"), first, rest)
    whole = F.rpad(F.concat(first, rest), power + 1, F.lit("0"))
    digits = F.concat(first, rest)
    large = F.when(F.length(digits) <= power + 1, F.concat(whole, F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    written = F.concat(first, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), tail)
    words = F.when(s == "NaN", "nan").when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").otherwise(s)
    return F.when(~s.contains("E"), words).otherwise(F.concat(sign, F.when(power == -4, small).when((power >= 7) & (power < 16), large).otherwise(written)))


def csv_view(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns as text: missing and null ones empty, booleans as True and False."""
    kinds = dict(rows.dtypes)

    def shown(c: str) -> Column:
        if c not in kinds:
            return F.lit("").alias(c)
        x = F.when(F.col(c), "True").otherwise("False") if kinds[c] == "boolean" else plain_number(F.col(c)) if kinds[c] == "double" else F.col(c).cast("string")
        return F.coalesce(F.when(F.col(c).isNotNull(), x), F.lit("")).alias(c)

    return rows.select(*map(shown, columns))


def csv_line(*columns: str) -> Column:
    """The fields between commas, in quotes where they hold a comma, a quote or a line end."""

    def quoted(c: str) -> Column:
        doubled = F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.col(f"`{c}`").rlike('[",\r\n]'), doubled).otherwise(F.col(f"`{c}`"))

    return F.concat_ws(",", *map(quoted, columns))


def write_csv(rows: DataFrame, columns: tuple[str, ...], path: str, order: tuple[str, ...] = (), mode: str = "errorifexists") -> bool:
    """One CSV file with a header, its lines ended by CR and LF; nothing is written for no rows.  Rows are sorted and
    written by ranges; the file system joins them."""
    if rows.isEmpty():
        return False
    view = csv_view(rows.orderBy(*order) if order else rows, columns)
    write_joined(view.select(csv_line(*columns).alias("value")), path, ",".join(columns) + "\r\n", "\r\n", mode)
    return True


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII as an escape, those beyond U+FFFF as two."""
    four = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    code = lambda c: F.ascii(c).cast("long")
    above = lambda c: code(c) - 0x10000
    pair = lambda c: F.concat(four(F.lit(0xD800) + F.shiftright(above(c), 10)), four(F.lit(0xDC00) + above(c).bitwiseAND(F.lit(0x3FF))))
    escaped = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(code(c) < 128, c).when(code(c) < 0x10000, four(code(c))).otherwise(pair(c))), "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), escaped).otherwise(text)


def json_entries(rows: DataFrame, columns: tuple[str, ...], order: tuple[str, ...], key: Column | None = None) -> DataFrame:
    """value: an entry of a JSON list (or, with a key, of an object) for each row, beside the order's
    columns.  All but the first in the order begin with a comma."""
    body = ascii_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    if key is not None:
        body = F.concat(ascii_json(F.to_json(F.array(key))).substr(F.lit(2), F.length(ascii_json(F.to_json(F.array(key)))) - 2), F.lit(": "), body)
    (least,) = unused([*rows.columns, "value"], "least")
    first = rows.agg(F.min(F.struct(*order)).alias(least))
    shown = rows.crossJoin(first).withColumn("value", F.concat(F.when(F.struct(*order) == F.col(least), "").otherwise(", "), body))
    return shown.select(*order, "value")


def _indented(level: int):
    """JSON texts with two spaces a level, below ``level`` levels; strings are written in ASCII."""
    margin = "  " * level

    def run(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for text, names in zip(texts.to_pylist(), dropped.to_pylist()):
            whole = json.loads(text)
            for name in names or ():
                whole.pop(name, None)
            out.append(json.dumps(whole, indent=2).replace("\n", "\n" + margin))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")


def indented_entries(rows: DataFrame, columns: tuple[str, ...], order: tuple[str, ...], level: int, key: Column | None = None, dropped: Column | None = None) -> DataFrame:
    """value: an entry of a JSON list (or, with a key, of an object) for each row, indented, beside the order's
    columns.  All but the last in the order end with a comma.  ``dropped`` lists fields that a row doesn't have."""
    none = F.array().cast("array<string>")
    body = _indented(level)(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), dropped if dropped is not None else none)
    if key is not None:
        name = ascii_json(F.to_json(F.array(key)))
        body = F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(": "), body)
    (last,) = unused([*rows.columns, "value"], "last")
    ends = rows.agg(F.max(F.struct(*order)).alias(last))
    shown = rows.crossJoin(ends).withColumn("value", F.concat(F.lit("  " * level), body, F.when(F.struct(*order) == F.col(last), "").otherwise(",")))
    return shown.select(*order, "value")


def envelope(runs: DataFrame, regions: DataFrame, by_model: DataFrame, by_model_and_region: DataFrame, counts: tuple[int, int], started: str, finished: str, input_mode: str, models_file: str, order: tuple[str, ...] = ("model_pos", "file_name")) -> DataFrame:
    """The whole result as one JSON document, indented by two, in order: results in model and path order, then
    region results, then the summaries by key.  No row holds more than one result, however many there are.
    A failed run has no prediction.  counts: protocols and models, repeated ids counted repeatedly.

    The four tables are read more than once: hand in saved ones."""
    spark = runs.sparkSession
    json_columns = [c for c in ("prediction", "raw_output") if c in runs.columns]
    told = runs.withColumns({c: F.try_parse_json(c) for c in json_columns})
    hidden = {*order, "aligned", "gt_segments", "pred_segments", "gt_placeholders", "pred_placeholders", "gt_library", "pred_library", "response", "model", "run_number", *RUN_FIELDS}
    listed = lambda df: tuple(c for c in df.columns if c not in hidden)
    first = tuple(c for c in RUN_FIELDS if c in runs.columns)
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    label = F.concat_ws("::", "model_name", "region")
    (key,) = unused([*by_model.columns, *by_model_and_region.columns], "key")
    parts = [
        (1, indented_entries(told, first, order, 2, dropped=F.when(failed, F.array(*map(F.lit, json_columns))) if json_columns else None)),
        (3, indented_entries(regions, tuple(c for c in REGION_FIELDS if c in regions.columns) + tuple(c for c in listed(regions) if c not in REGION_FIELDS), (*order, "segment_index"), 2)),
        (5, indented_entries(by_model.withColumn(key, F.col("model_name")), tuple(c for c in by_model.columns if c != "model_name"), (key,), 3, F.col(key))),
        (7, indented_entries(by_model_and_region.withColumn(key, label), tuple(by_model_and_region.columns), (key,), 3, F.col(key))),
    ]
    head = {"run_started_at": started, "run_finished_at": finished, "models_file": models_file, "input_mode": input_mode, "protocol_count": counts[0], "model_count": counts[1]}
    there = {n: not df.isEmpty() for n, df in (("results", runs), ("region_results", regions), ("by_model", by_model), ("by_model_and_region", by_model_and_region))}
    opening = lambda n, marks, level, more="": "  " * level + f'"{n}": {marks[0] if there[n] else marks}' + ("" if there[n] else more)
    closing = lambda n, mark, level, more="": ["  " * level + mark + more] if there[n] else []
    frame = [
        (0, ["{", *(f"  {json.dumps(k)}: {json.dumps(v)}," for k, v in head.items()), opening("results", "[]", 1, ",")]),
        (2, [*closing("results", "]", 1, ","), opening("region_results", "[]", 1, ",")]),
        (4, [*closing("region_results", "]", 1, ","), '  "summary": {', opening("by_model", "{}", 2, ",")]),
        (6, [*closing("by_model", "}", 2, ","), opening("by_model_and_region", "{}", 2)]),
        (8, [*closing("by_model_and_region", "}", 2), "  }", "}"]),
    ]
    place = lambda df, n: F.col(n) if df.schema[n].dataType.typeName() == "string" else F.format_string("%020d", F.col(n).cast("long"))
    lines = spark.createDataFrame([(k, "\n".join(text)) for k, text in frame], "section int, value string").select("section", F.array().cast("array<string>").alias("place"), "value")
    for section, part in parts:
        names = [c for c in part.columns if c != "value"]
        lines = lines.unionByName(part.select(F.lit(section).alias("section"), F.array(*(place(part, n) for n in names)).alias("place"), "value"))
    return lines.orderBy("section", "place").select("value")


def start_lines(protocols: int, models: int, input_mode: str, models_file: str) -> list[str]:
    return [f"Starting benchmark: {models} models x {protocols} protocols = {models * protocols} runs", f"Input mode: {input_mode}", f"Models config: {models_file}"]


def progress_lines(scored: DataFrame, total: int) -> DataFrame:
    """run_number, line for every scored run (run_number, model_name, protocol_id, scores, error)."""
    label = F.format_string(f"[%d/{total}] %s | %s ...", "run_number", "model_name", "protocol_id")
    bad = F.coalesce(F.col("error"), F.lit("")) != ""
    end = F.when(bad, F.concat(F.lit(" ERROR: "), "error")).otherwise(F.format_string(" similarity=%.3f region=%.3f", "library_similarity", "ordered_region_accuracy"))
    return scored.select("run_number", F.concat(label, end).alias("line"))


HEADINGS = ("Average by model:", "Stratified by region:")


def report_lines(models: DataFrame, regions: DataFrame) -> DataFrame:
    """section, line: the two sections of the console report, each under a blank line and its heading, in
    order of their keys."""
    heads = models.sparkSession.createDataFrame([(k, at, "", line) for k, heading in enumerate(HEADINGS, 1) for at, line in ((0, ""), (1, heading))], "section int, at int, key string, line string")
    first = models.select(F.lit(1).alias("section"), F.lit(2).alias("at"), F.col("model_name").alias("key"), F.format_string("  %s: similarity=%.3f exact=%.3f region=%.3f success=%d/%d", "model_name", "avg_library_similarity", "library_exact_rate", "avg_ordered_region_accuracy", "successes", "runs").alias("line"))
    second = regions.select(F.lit(2).alias("section"), F.lit(2).alias("at"), F.concat_ws("::", "model_name", "region").alias("key"), F.format_string("  %s | %s: seq=%.3f exact=%.3f len=%.3f type=%.3f", "model_name", "region", "avg_sequence_similarity", "sequence_exact_rate", "length_exact_rate", "region_exact_rate").alias("line"))
    return heads.unionByName(first).unionByName(second).orderBy("section", "at", "key").select("section", "line")


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def write_texts(documents: DataFrame, put: Callable[[str, bytes], None]) -> DataFrame:
    """Rows with target and text, after ``put`` has taken each text as UTF-8, empty ones too."""
    schema = documents.schema

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for target, text in zip(batch["target"], batch["text"]):
                put(target, text.encode())
            yield batch

    return documents.mapInPandas(call, schema)


def stamp(at: Column) -> Column:
    """A time for file names, in the session's zone (UTC)."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def isoformat(at: Column) -> Column:
    """A UTC time to microseconds; a whole second shows none."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") == "000000", "").otherwise(F.date_format(at, ".SSSSSS")), F.lit("+00:00"))
