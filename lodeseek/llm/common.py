"""What the training-data operators share: table reads, the shared folder, written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyarrow import RecordBatch
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in a batch that goes to a Python worker.
ARROW_ROWS = 512

#: White space of the word contracts: space and the controls from tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a local session names none (tests), a temporary folder is made once and put in the
    session's settings, so that every operator of the session uses the same one. A cluster must name it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodeseek-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; Spark deletes what lies there when the session's JVM ends."""
    path = f"{shared_dir(spark)}/lodeseek/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where.getParent())
    files.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are written for one computation, and deleted once its result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str, **options: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, tag))
        df.write.options(**options).parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def close(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def mapped(df: DataFrame, run: Callable[[Iterator[RecordBatch]], Iterator[RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of ARROW_ROWS rows for the session: rows here are whole texts, and both sides hold a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(run, schema)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def share_below(key: Column, share: float, seed: int) -> Column:
    """True for about that share of the rows, chosen by a hash of key (so retries choose alike)."""
    if share >= 1:
        return F.lit(True)
    steps = 1 << 30
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(steps)) < int(share * steps)
