"""Named reports over a label table that is given by name; the name is checked before Spark resolves it."""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions.scalars import ratio
from gradus.operators import checks

_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*){0,2}", re.ASCII)
# The names of the reports and of their columns.


def label_integrity(rows: DataFrame, splits: Sequence[str]) -> DataFrame:
    """One row: how many rows and ids there are, and how many rows break each of the label table's rules."""
    rules = {
        "missing_ids": F.btrim(F.col("id_code").cast("string")) != "",
        "invalid_grades": checks.is_grade("diagnosis"),
        "invalid_splits": F.col("split").isin(*splits),
        "invalid_referral_flags": F.col("is_referable") == (F.col("diagnosis") >= 2),
    }
    return checks.violations(rows, rules, F.count(F.lit(1)).alias("label_rows"), F.count_distinct("id_code").alias("distinct_ids"))


def load_verification(rows: DataFrame, splits: Sequence[str]) -> DataFrame:
    """(split, diagnosis, n): what a load should have brought in."""
    return rows.groupBy("split", "diagnosis").agg(F.count(F.lit(1)).alias("n"))


def grade_distribution(rows: DataFrame, splits: Sequence[str]) -> DataFrame:
    """(split, diagnosis, n, split_share): each grade's share of its split. The window runs on one row for each grade."""
    whole = F.sum("n").over(Window.partitionBy("split"))
    return load_verification(rows, splits).withColumn("split_share", ratio(F.col("n"), whole))


def referral_prevalence(rows: DataFrame, splits: Sequence[str]) -> DataFrame:
    """(split, eyes, referable, referable_share)."""
    per = rows.groupBy("split").agg(F.count(F.lit(1)).alias("eyes"), F.sum(F.when(F.col("is_referable"), 1).otherwise(0)).alias("referable"))
    return per.withColumn("referable_share", ratio(F.col("referable"), F.col("eyes")))


def repeated_id_across_splits(rows: DataFrame, splits: Sequence[str]) -> DataFrame:
    """(id_code, split_count, occurrences) of ids that several splits hold, first counted by id and split."""
    per = rows.groupBy("id_code", "split").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("id_code").agg(F.count("split").alias("split_count"), F.sum("n").alias("occurrences")).where("split_count > 1")


REPORTS = {f.__name__: f for f in (label_integrity, grade_distribution, referral_prevalence, repeated_id_across_splits, load_verification)}


def run(spark: SparkSession, name: str, labels: str, splits: Sequence[str] = checks.SPLITS) -> DataFrame:
    """The report's result over the table or view ``labels`` (id_code, diagnosis, split, is_referable); repeated ids come in order, the most spread first."""
    if not _NAME.fullmatch(labels):
        raise ValueError(f"not a table name: {labels!r}")
    rows = REPORTS[name](spark.table(labels), splits)
    return rows.orderBy(F.desc("split_count"), "id_code") if name == "repeated_id_across_splits" else rows


def estimate(spark: SparkSession, name: str, labels: str) -> str:
    """The plan with Spark's cost estimates, without running it."""
    with contextlib.redirect_stdout(io.StringIO()) as said:
        run(spark, name, labels).explain("cost")
    return said.getvalue()
