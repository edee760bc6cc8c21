"""Joins with a contract: keys that must be unique, ids that must match, rows that may only leave one side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.scalars import stem
from gradus.operators.checks import ContractError, require_unique


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner", complete: bool = False) -> DataFrame:
    """Joins after both keys have been found unique; ``complete`` requires a partner for each left row."""
    require_unique(left, key)
    require_unique(right, key)
    if complete:
        missing = [r[0] for r in left.join(right, key, "left_anti").select(key).limit(5).collect()]
        if missing:
            raise ContractError(f"no match for {key} {missing}")
    return left.join(right, key, how)


def reconcile(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: ids on both sides, on one only, and for each column the matched rows in which it differs (nulls equal)."""
    a, b = (df.select(key, *[F.col(c).alias(c + side) for c in columns], F.lit(True).alias("has" + side)) for df, side in ((left, "_a"), (right, "_b")))
    both = a.join(b, key, "full_outer")
    matched = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    return both.agg(
        F.count_if(matched).alias("matched"), F.count_if(F.col("has_b").isNull()).alias("only_left"), F.count_if(F.col("has_a").isNull()).alias("only_right"),
        *[F.count_if(matched & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_differs") for c in columns],
    )


def drop_leaked(df: DataFrame, leaked: DataFrame, key: str, split: str = "split", only: str = "train") -> DataFrame:
    """Removes leaked ids from one split only; an empty leak list is an error of order, not a clean corpus."""
    if leaked.isEmpty():
        raise ContractError("the leak list is empty")
    marked = leaked.select(F.col(key).alias("_leaked"), F.lit(only).alias("_only")).distinct()
    return df.join(marked, (df[key] == F.col("_leaked")) & (df[split] == F.col("_only")), "left_anti")


def pairs_within(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, pairs, conflicts, gap_sum) without making pairs: a group's counts of each value give them.

    Among n rows with n_v of value v there are n(n-1)/2 pairs, sum n_v(n_v-1)/2 of which agree.
    """
    counts = df.groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumns({"below": F.coalesce(F.sum("n").over(w), F.lit(0)), "below_sum": F.coalesce(F.sum(F.col("n") * F.col("v")).over(w), F.lit(0))})
    return rows.groupBy(group).agg(
        (F.sum("n") * (F.sum("n") - 1) / 2).cast("long").alias("pairs"), F.sum(F.col("n") * F.col("below")).alias("conflicts"),
        F.sum(F.col("n") * (F.col("v") * F.col("below") - F.col("below_sum"))).alias("gap_sum"),
    )


def remap(df: DataFrame, mapping: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Replaces values that ``mapping`` (unique ``old``) knows; others stay."""
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def correspondence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids of both sides, of the left only, of the right only, from one full join of distinct ids."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))


def aligned(rows: DataFrame, reference: DataFrame, key: str, place: str, columns: Sequence[str]) -> DataFrame:
    """One row: ids on one side only, matched rows whose ``place`` differs, and those in which each of ``columns`` differs."""
    found = reconcile(rows, reference, key, [place, *columns]).withColumnRenamed(f"{place}_differs", "moved")
    return found.withColumn("aligned", reduce(Column.__and__, [F.col(c) == 0 for c in found.columns if c != "matched"]))


def align_stems(rows: DataFrame, files: DataFrame, name: str, file: str) -> DataFrame:
    """``rows`` with ``name`` replaced by the file of the same stem, whatever its suffix and folder; ambiguous or absent stems raise."""
    known = files.select(stem(F.col(file)).alias("_stem"), F.col(file).alias("_file"))
    mine = rows.withColumn("_stem", stem(F.col(name)))
    require_unique(known.join(mine.select("_stem").distinct(), "_stem", "left_semi"), "_stem")
    out = mine.join(known, "_stem", "left")
    missing = [r[0] for r in out.where(F.col("_file").isNull()).select(name).limit(5).collect()]
    if missing:
        raise ContractError(f"no file for {missing}")
    return out.withColumn(name, F.col("_file")).drop("_stem", "_file")


def lookups(rows: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Adds a column of each of ``tables`` (key, column; unique keys) where it knows the key, else null; the planner broadcasts small ones."""
    for column, known in tables.items():
        require_unique(known, key)
        rows = rows.join(known.select(key, column), key, "left")
    return rows
