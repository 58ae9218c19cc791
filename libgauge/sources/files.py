"""Single files: whole texts written by tasks exactly once, and ordered tables joined to one file."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The file system copies so much at a time where it can't join files itself.
COPY_BYTES = 4 << 20


def _store_of(path: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def replace_file(path: str, content: bytes) -> None:
    """Write beside the target under a name of this attempt's own, then rename: two attempts at once, or one that
    dies, leave a whole file or none, and what a failed attempt has written goes.  A path with a scheme
    goes to that store; on a cluster a path without one must lie in a folder that all machines mount."""
    store, place = _store_of(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(part) as f:
            f.write(content)
        store.move(part, place)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(part)
        raise


def read_file(path: str) -> bytes | None:
    """A file's bytes, None if it isn't there."""
    store, place = _store_of(path)
    try:
        with store.open_input_stream(place) as f:
            return f.read()
    except FileNotFoundError:
        return None


def remove_file(path: str) -> None:
    """The file may be gone: a task may run twice."""
    store, place = _store_of(path)
    with contextlib.suppress(FileNotFoundError):
        store.delete_file(place)


def write_joined(lines: DataFrame, path: str, head: str = "", line_end: str = "\n", mode: str = "errorifexists") -> None:
    """One file: the head, then each row's ``value`` and a line end, in the order of the DataFrame's partitions.

    Tasks write the parts; after the job the file system joins them under another name (HDFS by reference, other
    stores by a copy that holds COPY_BYTES), and the result is renamed, so the file is whole or absent.
    """
    spark = lines.sparkSession
    target = _path(spark, path)
    fs = target.getFileSystem(_conf(spark))
    if fs.getUri().getScheme() == "file":
        fs = fs.getRawFileSystem()  # without files of checksums beside the result
    if fs.exists(target) and mode != "overwrite":
        raise FileExistsError(path)
    parts = f"{path.rstrip('/')}.{uuid.uuid4().hex}.parts"
    try:
        lines.select("value").write.option("lineSep", line_end).text(parts)
        found = sorted((f.getPath() for f in fs.listStatus(_path(spark, parts)) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        whole = _path(spark, f"{parts}/whole")
        out = fs.create(whole)
        out.write(bytearray(head.encode()))
        if not _by_reference(spark, fs, out, whole, found):
            for p in found:
                source = fs.open(p)
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, COPY_BYTES, False)
                source.close()
            out.close()
        if mode == "overwrite":
            fs.delete(target, True)
        if not fs.rename(whole, target):
            raise OSError(f"{path} can't be written")
    finally:
        fs.delete(_path(spark, parts), True)


def _by_reference(spark: SparkSession, fs, out, whole, parts: list) -> bool:
    """Join without a copy, where the file system can."""
    if fs.getUri().getScheme() != "hdfs" or not parts:
        return False
    out.close()
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
    for k, p in enumerate(parts):
        array[k] = p
    fs.concat(whole, array)
    return True


def _conf(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)
