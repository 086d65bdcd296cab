"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin_runtime, scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 512  # rows of whole texts in one Arrow batch; bounds a Python worker's memory


def pin(spark: SparkSession) -> None:
    pin_runtime(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # a step's shuffle files go when the step's table is written; a lost one is shuffled anew
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """Written intermediate tables in the shared folder, removed once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stage(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "llm")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def release(self, *frames: DataFrame) -> None:
        for frame in frames:
            _, path = self.paths.pop(id(frame))
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def text_of(name: str) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def arrow_texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``fn(record batch) -> record batch or None`` over the partitions of ``df``, one Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain constants) on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def rank_rows(df: DataFrame, keys: list[str], order: list[str], per_slot: int = 50_000) -> DataFrame:
    """``_rank`` from 0 inside ``keys``, without putting a key into one task.

    Rows are dealt to slots by a hash of ``order``; a slot is numbered by a window and starts where the
    slots before it end.  ``order`` must tell rows apart up to full equality, so that reruns agree.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    slots = max(1, -(-largest // per_slot))
    from pyspark.sql import Window

    slotted = df.withColumn("_slot", F.pmod(F.xxhash64(*order), F.lit(slots)))
    starts = slotted.groupBy(*keys, "_slot").count().withColumn(
        "_start", F.sum("count").over(Window.partitionBy(*keys).orderBy("_slot")) - F.col("count")).drop("count")
    numbered = slotted.withColumn("_in_slot", F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order)) - 1)
    return numbered.join(starts, [*keys, "_slot"]).withColumn("_rank", F.col("_start") + F.col("_in_slot")).drop("_slot", "_start", "_in_slot")
