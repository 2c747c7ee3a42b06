"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scrivano.sources.shared import new_path, own_dir, small_batches  # noqa: F401  the operators take it from here

def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there.

    The table belongs to who asked for it: an operator drops what its result doesn't read, and the rest stays until close.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    # Spark deletes shuffle files once their plan is collected as garbage, which a driver with memory to spare may not do for long.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)


def close(spark: SparkSession) -> None:
    """Deletes all tables of this application; results that are not yet collected are lost with them."""
    _delete(spark, own_dir(spark))


#: In a Python worker, which stages share: the operator that runs there, and what empties the cache of each.
_running: list[str] = []
_emptied_by: dict[str, Callable[[], None]] = {}


def claim(owner: str, empty: Callable[[], None] | None = None) -> None:
    """Says in a worker, before each batch, which operator runs now.

    What Arrow's pool holds of earlier batches goes back to the system. Where another operator ran before, its caches are
    emptied, as workers outlive stages, and what the C library holds of them goes back too.
    """
    if empty:
        _emptied_by[owner] = empty
    if _running != [owner]:
        _running[:] = [owner]
        for name, other in _emptied_by.items():
            if name != owner:
                other()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    pa.default_memory_pool().release_unused()


def free(spark: SparkSession) -> None:
    """Lets go of the shuffle files of tables that are written and that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)  # the files are deleted by a thread of its own
