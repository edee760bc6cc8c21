"""Contracts on tables: violations are counted in one pass and raise, never drop or repair rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "valid", "test")


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")


def require_unique(df: DataFrame, key: str) -> None:
    """A key without nulls or repeats; the message names the first offenders."""
    bad = df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).orderBy(key).limit(5).collect()
    if bad:
        raise ContractError(f"{key} is null or repeated: {[r[0] for r in bad]}")


def violations(df: DataFrame, rules: dict[str, Column], *also: Column) -> DataFrame:
    """One row: the aggregates ``also``, then the rows for which each rule does not hold; a rule that is null does not hold."""
    return df.agg(*also, *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def require(df: DataFrame, rules: dict[str, Column], nonempty: bool = True) -> None:
    row = violations(df, rules | {"_none": F.lit(False)}).first().asDict()
    if nonempty and not row["_none"]:
        raise ContractError("the table is empty")
    broken = {k: v for k, v in row.items() if v and k != "_none"}
    if broken:
        raise ContractError(f"rows that break a rule: {broken}")


def is_grade(column: str) -> Column:
    c = F.col(column)
    return c.between(0, 4) & (c == F.floor(c))


def is_split(column: str) -> Column:
    return F.col(column).isin(*SPLITS)


def is_safe_id(column: str) -> Column:
    """An id that can be a file name: not blank, no surrounding blanks, no path separators, NUL, ``.`` or ``..``."""
    c = F.col(column)
    return (c != "") & (F.trim(c) == c) & ~c.isin(".", "..") & ~c.rlike(r"[/\\\x00]")


def is_cluster(column: str) -> Column:
    c = F.lower(F.trim(F.col(column).cast("string")))
    return (c != "") & ~c.isin("nan", "none")


def is_score(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def is_probability(column: str) -> Column:
    return is_score(column) & F.col(column).between(0.0, 1.0)


def require_cuts(cuts: Sequence[float], n: int = 4) -> None:
    if len(cuts) != n or any(c != c or abs(c) == float("inf") for c in cuts) or list(cuts) != sorted(set(cuts)):
        raise ContractError(f"{n} finite, strictly increasing cuts are needed, not {list(cuts)}")


def require_labels(df: DataFrame, key: str = "id_code", grade: str = "diagnosis", split: str = "split") -> None:
    """The label table's contract: columns, grades, splits, unique keys."""
    require_columns(df, [key, grade, split])
    require(df, {grade: is_grade(grade), split: is_split(split)})
    require_unique(df, key)


def is_whole_grade(column: str) -> Column:
    """Text that says a grade: one digit, perhaps with zeros behind a point."""
    return F.col(column).rlike(r"\A[0-4](\.0+)?\z")


def valid_cuts(cuts: Column, n: int = 4) -> Column:
    """Whether an array holds ``n`` finite cuts that strictly increase."""
    whole = F.forall(cuts, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rising = F.forall(F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts)), lambda a, b: F.coalesce(a < b, F.lit(True))), lambda x: x)
    return F.coalesce(F.when(F.size(cuts) == n, whole & rising), F.lit(False))


def binary_scores(df: DataFrame, y: Column, score: str, by: Sequence[str] = (), probability: bool = False) -> DataFrame:
    """(by, n, bad_labels, bad_scores, usable): curves need labels, finite scores (or probabilities) and both classes."""
    rule = is_probability(score) if probability else is_score(score)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y.isNull()).alias("bad_labels"), F.count_if(~F.coalesce(rule, F.lit(False))).alias("bad_scores"), F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"),
    )
    usable = (F.col("bad_labels") == 0) & (F.col("bad_scores") == 0) & (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return counts.withColumn("usable", usable).drop("_pos", "_neg")


def require_eyes(df: DataFrame, key: str = "id_code", grade: str = "diagnosis", raw: str = "raw") -> DataFrame:
    """(key, grade INT, raw DOUBLE) of scored rows, ids trimmed: unique ids, whole grades, finite scores, at least one row, else it raises."""
    require_columns(df, [key, grade, raw])
    rows = df.select(F.trim(F.col(key).cast("string")).alias(key), F.col(grade).try_cast("double").alias(grade), F.col(raw).try_cast("double").alias(raw))
    require(rows, {key: F.col(key) != "", grade: is_grade(grade), raw: is_score(raw)})
    require_unique(rows, key)
    return rows.withColumn(grade, F.col(grade).cast("int"))


def not_exactly_one(files: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, n) of the wanted keys that have no file or several."""
    n = F.coalesce("n", F.lit(0))
    found = wanted.select(key).distinct().join(files.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left")
    return found.select(key, n.alias("n")).where("n <> 1")
