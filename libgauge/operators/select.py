"""Selection, limits, numbering and input routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import filled, strip
from ..store import unused
from .number import number_rows


def wanted_ids(ids: DataFrame, column: str) -> DataFrame:
    """Trimmed, distinct ids without blank ones."""
    return ids.select(strip(F.col(column)).alias(column)).filter(F.col(column) != "").distinct()


def keep_wanted(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    return rows.join(wanted, column, "left_semi")


def unknown_ids(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """One row: the wanted ids that no row has, sorted and joined by commas."""
    missing = wanted.join(rows.select(column), column, "left_anti")
    return missing.agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ", ").alias("missing"))


def refuse_unknown(rows: DataFrame, wanted: DataFrame, column: str) -> None:
    """Stop with the unknown ids' names.  This is the one action here; run it before the plan."""
    missing = unknown_ids(rows, wanted, column).first()["missing"]
    if missing:
        raise ValueError(f"Unknown {column}(s): {missing}")


def first_rows(rows: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first n rows by an order; a negative n leaves out the last -n; None keeps all."""
    if n is None:
        return rows
    if n >= 0:
        return rows.orderBy(*order).limit(n)
    last = rows.count() + n
    (place,) = unused(rows.columns, "place")
    return number_rows(rows, place, *order).filter(F.col(place) <= last).drop(place)


def run_numbers(runs: DataFrame, *order: Column | str) -> DataFrame:
    """run_number from 1 in the given order."""
    return number_rows(runs, "run_number", *order)


def choose(protocols: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Descriptions with the wanted ids (all if none is left after blanks are dropped), the first ``limit``
    of them in path order.  Unknown ids and an empty choice stop the run."""
    wanted = sorted({i.strip() for i in ids or () if i.strip()})
    if wanted:
        asked = protocols.sparkSession.createDataFrame([(i,) for i in wanted], "protocol_id string")
        refuse_unknown(protocols, asked, "protocol_id")
        protocols = keep_wanted(protocols, asked, "protocol_id")
    chosen = first_rows(protocols, limit, "file_name")
    if chosen.isEmpty():
        raise ValueError("No protocols selected for benchmarking")
    return chosen


MESSAGES = {"pdf": "missing protocol PDF", "text": "missing protocol text", "url": "missing protocol URL"}


def route_input(rows: DataFrame, mode: str, pdf: str = "pdf_path", text: str = "text_path", url: str = "protocol_url", pdf_there: str | None = None, text_there: str | None = None) -> DataFrame:
    """source_used, source_kind and error by input mode; ``auto`` takes the first of PDF, text and URL.  A path
    counts if it isn't null and, where a column tells whether the file is there, that is true."""
    known = lambda path, there: F.col(path) if there is None else F.when(F.col(there), F.col(path))
    columns = {"pdf": known(pdf, pdf_there), "text": known(text, text_there), "url": filled(F.col(url))}
    if mode == "auto":
        message = "no usable input source found"
    elif mode in columns:
        columns, message = {mode: columns[mode]}, MESSAGES[mode]
    else:
        raise ValueError(f"Unsupported input mode: {mode}")
    used, kind = F.coalesce(*columns.values()), F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in columns.items()))
    return rows.withColumns({"source_used": F.coalesce(used, F.lit("")), "source_kind": kind, "error": F.when(used.isNull(), F.lit(message))})


def skip_existing(rows: DataFrame, existing: DataFrame, column: str) -> DataFrame:
    return rows.join(existing.select(column), column, "left_anti")
