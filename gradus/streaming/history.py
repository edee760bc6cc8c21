"""A history of metrics by step, kept by a stream: replayed batches and restarts change nothing, the last write wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("run", "metric", "step")


def last_writes(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The row of each key that is last in ``order``, whose columns must leave no ties in a key; counted map-side, so a hot key shuffles a row a task."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def log_metrics(stream: DataFrame, store: str, checkpoint: str, order: Sequence[str], keys: Sequence[str] = KEYS) -> None:
    """Takes what is new in ``stream`` into ``store``, then stops.

    A batch leaves the last write of each of its keys in a folder of its own number, over whatever an earlier attempt at the
    batch left there. The checkpoint says which batches are done.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        last_writes(batch, order, keys).write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def metric_history(spark: SparkSession, store: str, order: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The last write of each key over all batches."""
    return last_writes(spark.read.parquet(store).drop("batch"), order, keys)


def compact(spark: SparkSession, store: str, into: str, order: Sequence[str], keys: Sequence[str] = KEYS) -> None:
    """Writes the history to a new store as one batch, to go on from with a new checkpoint; never over an existing one."""
    metric_history(spark, store, order, keys).write.mode("errorifexists").parquet(f"{into}/batch=-1")
