"""Shared helpers: landing intermediate tables and tokenising text columns natively."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfgap-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are landed and no longer used.

    It acts when the driver's garbage is collected, which may be long after a
    large shuffle is done with.
    """
    gc.collect()
    for _ in range(2):   # the first pass ends what holds the shuffles, the second the shuffles
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


BROADCAST_ROWS = 1_000_000   # of 8-byte keys


def prefilter(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``rows`` whose ``on`` is among the landed ``keys``, ahead of a join on it that moves the rows.

    The keys are broadcast where their count is within BROADCAST_ROWS;
    otherwise the rows stay as they are, and the join does it all.
    """
    if keys.count() > BROADCAST_ROWS:
        return rows
    return rows.join(F.broadcast(keys.select(on)), on, "left_semi")


def row_key(*cols: str) -> Column:
    """64 bits that stand for a row's values, never null; N distinct rows collide with probability about N * N / 2^65."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def without_rows(docs: DataFrame, gone: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` of ``cols`` is in the one column of ``gone``.

    The keys are landed and counted: up to BROADCAST_ROWS of them are broadcast,
    so the texts stay where they are; more take a join that moves the rows.
    """
    gone = land(gone.toDF("_gone").distinct(), name)
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, row_key(*cols) == gone["_gone"], "left_anti").select(docs.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept away from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
