"""A store of results that knows what each was made from, so that a second run computes what is new only."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators.checks import ContractError, require_columns, require_unique
from gradus.sources.sinks import strict_json

BUCKETS = 64


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path that all executors reach: below spark.checkpoint.dir, or on a local master without one in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gradus-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _digest(columns: Sequence[str], *more: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *more, F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})), 256)


@dataclass
class Refreshed:
    """``results`` are the key, the result columns and ``reused``; ``counts`` says how many rows were same, changed, added, missing."""

    results: DataFrame
    counts: dict[str, int]

    @property
    def computed(self) -> int:
        return self.counts.get("changed", 0) + self.counts.get("added", 0)


def refresh(source: DataFrame, path: str, key: str, settings: dict, compute: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> Refreshed:
    """The results of ``compute`` for all of ``source``, of which only those are computed that the store at ``path`` lacks.

    A result is signed by its row's contents and by ``settings``, and carries a digest of its own. It is reused if the row
    and settings sign alike and the stored result has its digest: a row that changed, other settings and a damaged result
    are computed anew. ``compute`` takes rows of ``source`` and returns ``key`` and the result columns, one row for each.
    Buckets with a row that is not the same are written again, to a new folder first and then in place; a run that fails in
    between leaves results that are still verified, or computed again. Keys must be unique.
    """
    spark = source.sparkSession
    require_columns(source, [key])
    require_unique(source, key)
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    wanted = source.select(key, _digest(source.columns, F.lit(strict_json(settings))).alias("_signature"))
    try:
        stored = spark.read.parquet(f"{path}/rows").where(F.col(key).isNotNull())
        columns = [c for c in stored.columns if c not in (key, "_signature", "_check", "_run", "bucket")]
        stored = stored.where(F.col("_check") == _digest([key, *columns]))
    except AnalysisException:  # the first run
        stored, columns = None, []
    was = (stored if stored is not None else wanted.limit(0)).select(key, F.col("_signature").alias("_was"))
    state = F.when(F.col("_signature").isNull(), "missing").when(F.col("_was").isNull(), "added").when(F.col("_was") == F.col("_signature"), "same").otherwise("changed")
    run, scratch = uuid.uuid4().hex, f"{path}/staged-{uuid.uuid4().hex}"
    wanted.join(was, key, "full_outer").select(key, "_signature", state.alias("_state"), bucket.alias("bucket")).write.parquet(f"{scratch}/states")
    states = spark.read.parquet(f"{scratch}/states")
    counts = {r["_state"]: r.n for r in states.groupBy("_state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if stored is None and not counts:
        return Refreshed(compute(source).withColumn("reused", F.lit(False)), counts)
    if set(counts) - {"same"}:
        new = states.where(F.col("_state").isin("changed", "added")).select(key, "_signature", "bucket")
        fresh = compute(source.join(new.select(key), key, "left_semi"))
        columns = [c for c in fresh.columns if c != key]
        fresh = fresh.withColumns({"_check": _digest([key, *columns]), "_run": F.lit(run)}).join(new, key)
        # A row without a key in each bucket that is written, so that one whose last row went is written too.
        touched = states.where("_state <> 'same'").select("bucket").distinct()
        names = [key, *columns, "_check", "_run", "_signature", "bucket"]
        rows = fresh.select(*names).unionByName(touched, allowMissingColumns=True)
        if counts.get("same"):
            if not set(columns) <= set(stored.columns):
                raise ContractError("results with other columns need other settings")
            same = states.where("_state = 'same'").join(touched, "bucket", "left_semi").select(key)
            rows = rows.unionByName(stored.join(same, key, "left_semi").select(*names))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{scratch}/rows")
        spark.read.parquet(f"{scratch}/rows").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    where, folder = pafs.FileSystem.from_uri(scratch)
    where.delete_dir(folder)
    results = spark.read.parquet(f"{path}/rows").join(wanted, [key, "_signature"])
    return Refreshed(results.select(key, *columns, (F.col("_run") != run).alias("reused")), counts)
