"""The folder that driver and executors share, and the bounds of what Python workers hold."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Largest Arrow batch handed to a Python worker, in rows and in bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by rows and bytes, so that long texts don't fill a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master gets a folder of this machine that goes at exit.

    On a cluster such a folder would be another one on each machine, so there it is an error.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="scrivano-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        context.setCheckpointDir(where)
        where = context.getCheckpointDir()
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/scrivano-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rename_files(spark: SparkSession, folder: str, extension: str) -> None:
    """Gives the data files in a folder's folders another extension."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/*/part-*")
    system = where.getFileSystem(conf)
    for status in system.globStatus(where):
        path = status.getPath()
        system.rename(path, jvm.org.apache.hadoop.fs.Path(re.sub(r"\.[a-z]+$", "", path.toString()) + extension))


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder of written files to target, in place of what is there; target is an empty one where source is none."""
    jvm = spark.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    system = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(new, True)
    if system.exists(old) and not system.rename(old, new):
        raise OSError(f"{source} can't be moved to {target}")
    system.create(jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")).close()
