"""Tables in the folder that driver and executors share.  They cut lineage, survive the loss of executors,
and are deleted when their store is closed."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession

#: Stores of this process that still hold tables.
_open: list[Store] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, local mode uses a folder of its own; a cluster is an error, as
    each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """Column names like these that are not among ``columns`` (whatever the case of their letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Store:
    """``save`` writes a DataFrame once and gives it back as a scan of what was written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/libgauge/{uuid.uuid4().hex}", 0
        _open.append(self)

    def save(self, df: DataFrame, seen: Observation | None = None, **counters) -> DataFrame:
        """With an observation, the counters are taken in the same pass."""
        path, self.tables = f"{self.root}/{self.tables}", self.tables + 1
        observed = df if seen is None else df.observe(seen, *(c.alias(n) for n, c in counters.items()))
        observed.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if self in _open:
            _open.remove(self)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """One table in a store of its own, which stays until ``close_all`` or the end of Python."""
    return Store(df.sparkSession).save(df)


def close_all() -> None:
    """Delete all tables; DataFrames that read them can't be used any more."""
    while _open:
        _open[-1].close()


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        close_all()
