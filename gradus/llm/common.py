"""What several corpus operators share: scratch tables, row keys, Arrow helpers."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Work columns start with this, so columns of the input cannot clash with them.
OWN = "_gradus_"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master without one a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{tempfile.gettempdir()}/gradus-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Spark deletes it when the application ends."""
    path = f"{shared_dir(spark)}/gradus/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(*cols: str) -> Column:
    """Names a row by its contents; equal rows have equal keys. Never null."""
    return F.xxhash64(*[F.col(c) for c in cols])


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``bad`` (row_key, doc_id) names; both the key and the id must be equal, nulls too."""
    key, doc = f"{OWN}key", f"{OWN}doc"
    named = bad.select(F.col("row_key").alias(key), F.col("doc_id").alias(doc)).distinct()
    mine = docs.withColumn(key, row_key("doc_id", "text"))
    return mine.join(named, (mine[key] == named[key]) & mine["doc_id"].cast("long").eqNullSafe(named[doc]), "left_anti").drop(key)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Strings as UTF-8 bytes, without decoding them."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def digest(values: list[str]) -> str:
    return hashlib.sha256(",".join(values).encode()).hexdigest()


_HELD: dict = {}


def let_go() -> None:
    """Called by tasks that keep nothing: what an earlier operator's tasks kept in the worker goes."""
    _HELD.clear()


def held(key: tuple, make):
    """What a worker process keeps from task to task, made once; another operator's task puts its own in its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
