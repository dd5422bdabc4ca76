"""What the operators share: reading tables, bounded Arrow batches, written intermediates."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; keeps a batch of long texts within a worker's memory.
BATCH_ROWS = 512
BATCH_BYTES = "32m"
#: Rows that are sent to every executor, at most, and the share of all rows that makes a key hot: fewer than HOT keys are.
BROADCAST_ROWS, HOT = 100_000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch limits to the module's, never raising what the session has."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000") or 10000)
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session, which has
    no other executors, gets an own folder, and any other an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="casegraph-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


#: Whether shuffle files go at the end of the SQL execution that wrote them; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` to the shared folder and read it again: cuts the lineage and survives lost executors. The shuffles of the
    write are deleted with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stashed table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def salts(spark: SparkSession) -> int:
    """Into how many parts a hot key is split: as many as the shuffle has partitions, 16 at least."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_totals(rows: DataFrame, totals: DataFrame, key: str, n_rows: int | None = None) -> DataFrame:
    """rows with the columns of `totals` for their value of `key` (null is a value), null where `totals` hasn't it.

    `totals` has one row a key, with `n`, how many of `rows` have it. If it is small it goes to every executor. Else only
    the hot keys' do, of which there are fewer than HOT, as each has more than one in HOT of all rows; the other rows meet
    theirs in a shuffle in which no key has more than that.
    """
    spark = rows.sparkSession
    totals, path = stash(totals, "totals")
    value = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))
    more = [c for c in totals.columns if c not in (key, "n")]
    totals = totals.select(value.alias("_key"), F.col("n").alias("_n"), *more)
    rows = rows.withColumn("_key", value)
    if totals.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(totals), "_key", "left").drop("_key", "_n")
    n_rows = totals.agg(F.sum("_n")).first()[0] if n_rows is None else n_rows
    hot = totals.where(F.col("_n") * HOT > n_rows)
    rest = totals.where(F.col("_n") * HOT <= n_rows)
    near = F.broadcast(hot.select("_key", "_n", *(F.col(c).alias(f"_hot_{c}") for c in more)))
    rows = rows.join(near, "_key", "left")
    spread = F.when(F.col("_n").isNull(), F.col("_key")).otherwise(F.concat(F.lit("~"), F.xxhash64(*(c for c in rows.columns if not c.startswith("_"))).cast("string")))
    rows = rows.withColumn("_key", spread).drop("_n").join(rest.drop("_n"), "_key", "left")
    return rows.select(*(c for c in rows.columns if not c.startswith("_hot_") and c not in more and c != "_key"), *(F.coalesce(f"_hot_{c}", c).alias(c) for c in more))
