"""Where downloads go: targets, clashes of extensions, and what is already there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import path_name, path_stem, path_suffix, safe_filename
from ..functions.urls import guess_extension
from ..store import unused
from .files import remove_file, replace_file


def own_target(path: Column, root: str) -> Column:
    """A path named by the description, from the root unless it is absolute."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def existing_targets(files: DataFrame, column: str = "path") -> DataFrame:
    """stem, existing: of several files with one stem the first by path."""
    return files.groupBy(path_stem(F.col(column)).alias("stem")).agg(F.min(column).alias("existing"))


def plan_targets(plan: DataFrame, files: DataFrame, root: str, folder: str) -> DataFrame:
    """Adds target and target_exists before anything is downloaded: the description's own path, else a
    file of the id's name with any extension, else that name.  existing is the target if it exists."""
    stem = safe_filename(F.col("protocol_id"))
    there = existing_targets(files.filter(F.col("path") == F.concat(F.lit(folder.rstrip("/") + "/"), path_name(F.col("path")))))
    at, own = unused([*plan.columns, "stem", "existing", "target", "target_exists"], "at", "own")
    named = files.select(F.col("path").alias(at)).distinct()
    found = plan.withColumn(own, stem).join(there, F.col(own) == F.col("stem"), "left")
    aimed = found.withColumn("target", F.when(F.col("target_path").isNotNull(), own_target(F.col("target_path"), root)).otherwise(F.coalesce("existing", F.concat(F.lit(folder.rstrip("/") + "/"), own))))
    return aimed.join(named, F.col("target") == F.col(at), "left").withColumns({"target_exists": F.col(at).isNotNull(), "existing": F.col(at)}).drop(own, "stem", at)


def pending(plan: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows with a status: skipped where there is no URL or the target exists, else null."""
    why = F.when(F.col("url").isNull() | (F.col("url") == ""), F.concat("protocol_id", F.lit(": no protocol_link URL")))
    if not overwrite:
        why = why.when(F.col("target_exists"), F.concat("protocol_id", F.lit(": "), "target", F.lit(" already exists")))
    return plan.withColumn("message", why).withColumn("status", F.when(F.col("message").isNotNull(), "skipped"))


def final_targets(downloads: DataFrame, root: str, folder: str) -> DataFrame:
    """After a download (content_type, final_url): extension, target and target_error.  A described path
    must have the extension that was found, whatever its case.  With a column existing (plan_targets)
    replaced is the file to remove: what exists under another name."""
    extension = guess_extension(F.col("content_type"), F.col("final_url"))
    rows = downloads.withColumn("extension", extension)
    own = own_target(F.col("target_path"), root)
    clash = F.col("target_path").isNotNull() & (F.lower(path_suffix(F.col("target_path"))) != F.lower("extension"))
    target = F.when(F.col("target_path").isNotNull(), own).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), safe_filename(F.col("protocol_id")), "extension"))
    text = F.concat("protocol_id", F.lit(": target path "), own, F.lit(" does not match downloaded extension "), "extension")
    done = rows.withColumn("target", target).withColumn("target_error", F.when(clash, text))
    return done.withColumn("replaced", F.when(F.col("existing") != F.col("target"), F.col("existing"))) if "existing" in downloads.columns else done


def store(downloads: DataFrame, put: Callable[[str, bytes], None] = replace_file, remove: Callable[[str], None] = remove_file, overwrite: bool = False) -> DataFrame:
    """protocol_id, target, status, message after ``put`` has taken each download without an error; with
    ``overwrite``, ``remove`` then takes the file of another name that it replaces.  On a cluster, hand in
    functions that write to the shared store."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("protocol_id", "target", "status", "message")])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                if r["status"] != "downloaded":
                    rows.append((r["protocol_id"], r["target"], r["status"], r["message"]))
                elif r["target_error"]:
                    rows.append((r["protocol_id"], r["target"], "error", r["target_error"]))
                else:
                    put(r["target"], r["content"])
                    if overwrite and r.get("replaced"):
                        remove(r["replaced"])
                    rows.append((r["protocol_id"], r["target"], "downloaded", f"{r['protocol_id']}: wrote {r['target']}"))
            yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    replaced = F.col("replaced") if "replaced" in downloads.columns else F.lit(None).cast("string").alias("replaced")
    return downloads.select("protocol_id", "target", "status", "message", "target_error", "content", replaced).mapInPandas(call, schema)


def exit_code(statuses: DataFrame) -> int:
    """1 if any row has the status error."""
    return int(not statuses.filter("status = 'error'").isEmpty())
