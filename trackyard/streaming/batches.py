"""Exactly-once output of a stream: micro-batch N owns the folder ``<out>/batch_id=N``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.sources.tables import Storage


def run_batches(stream: DataFrame, out: str, process: Callable[[DataFrame, int], DataFrame] | None = None,
                partition_by: Sequence[str] = (), after: Callable[[int], None] | None = None,
                mode: str = "append"):
    """Run ``stream`` to completion (availableNow) into ``out/batch_id=N``; returns the ended query.

    A retried batch overwrites its own folder.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        res = process(df, batch_id) if process else df
        res.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{out}/batch_id={batch_id}")
        if after:
            after(batch_id)

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_batches(spark: SparkSession, out: str, mark: str = "batch_id=") -> DataFrame | None:
    """What the batches wrote, with their ``batch_id``; None before the first one.

    Only a folder that holds no batch yet counts as empty: any other error of the read is raised.
    """
    if not any(n.startswith(mark) for n in Storage(spark).folders(out)):
        return None
    return spark.read.parquet(out)


def read_totals(spark: SparkSession, out: str, keys: Sequence[str], before: int | None = None) -> DataFrame:
    """Sums per key over all batches (below ``before``): the newest fold and the batches after it."""
    def add(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(c).cast(df.schema[c].dataType).alias(c)
                                       for c in df.columns if c not in (*keys, "batch_id", "upto")])
    parts = spark.read.parquet(out)
    if before is not None:
        parts = parts.where(F.col("batch_id") < before)
    folds = read_batches(spark, f"{out}-folds", "upto=")
    if folds is not None:
        if before is not None:
            folds = folds.where(F.col("upto") <= before)
        newest = folds.agg(F.max("upto")).first()[0]
        if newest is not None:
            parts = parts.where(F.col("batch_id") >= newest).drop("batch_id").unionByName(
                folds.where(F.col("upto") == newest).drop("upto"))
    return add(parts)
