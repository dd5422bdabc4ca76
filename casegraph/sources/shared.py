"""The folder that driver and executors share, and files that are replaced as a whole."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI and the path in it, for tasks; `file:/x` is taken as Hadoop writes it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def is_file(uri: str) -> bool:
    store, path = located(uri)
    return store.get_file_info(path).type == pyarrow.fs.FileType.File


def drop_file(uri: str) -> None:
    """Delete a file, if it is there."""
    if is_file(uri):
        store, path = located(uri)
        store.delete_file(path)


def drop_table(df: DataFrame, path: str) -> None:
    """Delete a stashed table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets an own folder, and any other an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="casegraph-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def replace_file(path: str, text: str) -> None:
    """Write a text file so that a reader sees all of it or what was there before."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=".part-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


#: Rows of an Arrow batch where a row is all that is known of a case.
CASE_ROWS = 512


@contextmanager
def small_batches(spark: SparkSession, rows: int = CASE_ROWS) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is run meanwhile, so that a Python worker's memory doesn't grow with
    the rows of its task; never more than the session has."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` to the shared folder and read it again, and where it is; whoever asks for it may delete it (drop_table)."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: it is computed once, and lost executors cost no more than a read."""
    return stash_at(df, name)[0]
