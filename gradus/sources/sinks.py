"""Writers: partitioned, exclusive, idempotent, and as Markdown."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.scalars import finite
from gradus.operators.checks import ContractError, require, require_eyes, require_unique
from gradus.operators.joins import join_one_to_one, remap
from gradus.sources.formats import PUBLICATION, SIDECAR, Publication, exists, file_digest


def write_labels(df: DataFrame, path: str) -> None:
    """By split, so that readers of one split read its files only."""
    df.repartition("split").sortWithinPartitions("split", "id_code").write.mode("overwrite").partitionBy("split").parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Never over an existing result."""
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        raise ContractError(f"{path} exists") from e


def save_table(df: DataFrame, name: str, buckets: int, by: str, sort: Sequence[str]) -> None:
    """A table bucketed by its join key: joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, by).sortBy(*sort).saveAsTable(name)


def append_runs(new: DataFrame, path: str, key: str = "run_name") -> None:
    """Appends the runs that ``path`` does not hold; a second call adds nothing."""
    spark = new.sparkSession
    try:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException:  # the first append
        pass
    new.write.mode("append").parquet(path)


def export_runs(df: DataFrame, metrics: Sequence[str], order: Sequence[str], commits: DataFrame | None = None) -> DataFrame:
    """Metrics rounded to 6 digits, NaN as null, rows in order with nulls last; ``commits`` (old, new) renames rewritten commits."""
    clean = {m: F.round(F.nanvl(F.col(m), F.lit(None).cast("double")), 6) for m in metrics}
    rows = df if commits is None else remap(df, commits, "commit", "old", "new")
    return rows.withColumns(clean).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def to_markdown(df: DataFrame, most: int = 200) -> str:
    """A table of at most ``most`` rows; undefined numbers are N/A."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError(f"more than {most} rows are no report")
    show = lambda v: "N/A" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def run_id(config: dict, fingerprint: str) -> str:
    """A name of a run by what it depends on: settings without order, and the data's fingerprint."""
    return hashlib.sha256(json.dumps([config, fingerprint], sort_keys=True, allow_nan=False).encode()).hexdigest()[:12]


def write_combined(df: DataFrame, path: str) -> None:
    """One table of all splits in order of split and id, beside a folder for each split."""
    df.orderBy("split", "id_code").write.mode("overwrite").parquet(f"{path}/all")
    write_labels(df, f"{path}/by_split")


def write_image_stats(df: DataFrame, path: str) -> None:
    """Image measures as CSV in order of split and id; the range sort spreads over all tasks."""
    df.orderBy("split", "id_code").write.mode("overwrite").option("header", True).csv(path)


def write_findings(problems: DataFrame, leaks: DataFrame, path: str) -> None:
    """The problem list and the list of leaked ids, a CSV folder each; empty lists are written too, with their header."""
    for name, rows in (("problems", problems), ("leaks", leaks)):
        rows.orderBy(*rows.columns).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_fold(rows: DataFrame, path: str, sweep: str, fold: int) -> None:
    """A fold's scores (id_code, test_true, test_raw) as the partition ``sweep=, fold=``; ids must be unique, a stored fold stays."""
    require_unique(rows, "id_code")
    write_new(rows, f"{path}/sweep={sweep}/fold={fold}")


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(sweep, fold, id_code, test_true, test_raw) of all stored folds; filters on sweep and fold read their files only."""
    return spark.read.parquet(path)


def write_run(df: DataFrame, path: str, config: dict) -> None:
    """A single run: its rows, and its settings as strict JSON; neither replaces an existing run."""
    write_new(df, f"{path}/rows")
    write_json(df.sparkSession.createDataFrame([(strict_json(config),)], "value string"), f"{path}/config")


def publish(df: DataFrame, path: str, about: dict) -> None:
    """Scores and the sidecar that signs them as one commit: both are there after it, or neither.

    Tasks write apart; the commit alone shows the folder ``path``, by a rename. An attempt that fails leaves nothing that is
    seen, and can be repeated. The sidecar has ``about``, the number of rows and each file's SHA-256. A result that is there
    already stays: a second call raises.
    """
    said = strict_json(about)
    if exists(path):
        raise ContractError(f"{path} exists")
    df.sparkSession.dataSource.register(Publication)
    df.write.format(PUBLICATION).option("path", path).option("about", said).mode("append").save()


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The scores, if their sidecar is there and the stored files are those that it signs; files are checked by tasks."""
    if not exists(path):
        raise ContractError(f"{path} was never published")
    store, folder = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{folder}/{SIDECAR}") as stream:
        said = json.loads(stream.read())
    there = {f.base_name for f in store.get_file_info(pafs.FileSelector(f"{folder}/scores")) if f.base_name.endswith(".parquet")}
    if there != set(said["files"]):
        raise ContractError(f"{path}: the files are not those that were signed: {sorted(there ^ set(said['files']))[:5]}")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [file_digest(pafs.FileSystem.from_uri(path)[0], f"{folder}/scores/{name}") == sha for name, sha in zip(frame["name"], frame["sha"], strict=True)]
            yield frame[~np.array(good, bool)][["name"]]

    files = spark.createDataFrame(sorted(said["files"].items()), "name string, sha string")
    bad = files.repartition(len(said["files"])).mapInPandas(check, "name string").limit(5).collect()
    if bad:
        raise ContractError(f"{path}: files that were changed: {[r.name for r in bad]}")
    return spark.read.parquet(f"{path}/scores")


def comparison_frame(spark: SparkSession, baseline: str, candidate: str) -> DataFrame:
    """(id_code, diagnosis, baseline_raw, candidate_raw) of two published results of the same eyes: signatures, contracts and truths must hold."""
    a, b = (require_eyes(read_published(spark, path)) for path in (baseline, candidate))
    both = join_one_to_one(a.withColumnRenamed("raw", "baseline_raw"), b.select("id_code", F.col("diagnosis").alias("_truth"), F.col("raw").alias("candidate_raw")), "id_code", "full_outer")
    require(both, {"same eyes": F.col("baseline_raw").isNotNull() & F.col("candidate_raw").isNotNull(), "same truth": F.col("diagnosis") == F.col("_truth")})
    return both.drop("_truth")


def strict_json(value: dict) -> str:
    """Sorted keys; NaN and infinities raise, as other readers don't know them."""
    return json.dumps(value, sort_keys=True, allow_nan=False)


def as_json(df: DataFrame) -> DataFrame:
    """(value): a JSON text for each row, keys in order of name, undefined numbers as null."""
    clean = {c: F.when(finite(F.col(c)), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(clean).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """Lines of text, never over an existing result."""
    try:
        df.write.mode("errorifexists").text(path)
    except AnalysisException as e:
        raise ContractError(f"{path} exists") from e
