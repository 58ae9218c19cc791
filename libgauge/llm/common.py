"""What the operators of this subpackage share: the shared folder, saved tables, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Arrow batches sent to Python hold at most this many bytes, whatever the length of the texts.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower()
    digits, unit = now.rstrip("kmgb"), now[len(now.rstrip("kmgb")) :][:1]
    size = int(digits) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit]
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is set, local mode uses one of its own; a
    cluster is an error, as each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Column names like these that are not among ``columns`` (whatever the case of their letters)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_marks(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's columns (maps and variants left out): an order of rows that comes from the data."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(F.lit(0), *plain), F.xxhash64(F.lit(1), *plain)


class Workspace:
    """Tables written to the shared folder.  They cut lineage and survive the loss of executors.

    ``save`` writes a DataFrame once and gives it back as a scan; ``drop`` removes tables that
    no later step reads.  An operator's result reads its workspace, so that stays until ``close``, or until
    ``close_all``, which a caller may call when its results are written and which runs when Python ends.
    """

    #: Workspaces of this process that still hold tables.
    live: list[Workspace] = []

    @classmethod
    def close_all(cls) -> None:
        while cls.live:
            cls.live[-1].close()

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = f"{name}-{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/libgauge/{self.name}"
        Workspace.live.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Nothing reads this job's shuffle files once the table is there: Spark deletes them with the job's end, not at
        some later garbage collection."""
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def save_dealt(self, df: DataFrame, table: str, buckets: int, column: str, compression: str = "zstd") -> DataFrame:
        """``save`` in buckets by a column, so that a join on it need not move the table.  Rows should come dealt by it
        already: a task writes a file for each bucket that it has rows of."""
        name = f"libgauge_{self.name.rpartition('-')[2]}_{table}"
        try:
            with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
                df.write.option("path", self.path(table)).option("compression", compression).bucketBy(buckets, column).saveAsTable(name)
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name alone: files at a path of their own stay

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(self.path(table))

    def keep(self, *tables: str) -> None:
        """Drop all tables but these."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for status in self._files(path).listStatus(path):
            if status.getPath().getName() not in tables:
                self._delete(status.getPath().toString())

    def close(self) -> None:
        if self in Workspace.live:
            Workspace.live.remove(self)
        self._delete(self.root)

    def read_by(self, df: DataFrame) -> bool:
        """Does a DataFrame still read tables of this workspace?"""
        return any(f"/{self.name}/" in file for file in df.inputFiles())

    def _files(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        self._files(path).delete(path, True)


@atexit.register
def _close_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        Workspace.close_all()


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null gives the empty text."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def as_columns(id_col: str, text_col: str) -> list[Column]:
    """The two columns an operator reads, under names of its own: others can't clash with them."""
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]


def rows_out(schema: pa.Schema, rows: Iterable[tuple], limit: int = BATCH_BYTES, size: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Pack row tuples into record batches of a bounded size."""
    held: list[tuple] = []
    weight = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*held)) if held else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in rows:
        held.append(row)
        weight += 200 + (size(row) if size else 0)
        if weight >= limit:
            yield flush()
            held.clear()
            weight = 0
    if held:
        yield flush()
