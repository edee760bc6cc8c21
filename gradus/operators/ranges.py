"""Running sums, ranks and exact quantiles over one long order, by ranges of its values instead of one sorted partition.

Values are cut into about equal ranges at approximate quantiles, which the driver holds (one number a range). Each range of a
group is sorted on its own, and starts from the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"


def cut(df: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """Adds the range (from 0) of the numeric column ``value``; equal values share one. Nulls have -1, NaN the last."""
    return placed(df, value, bounds(df, value, ranges))


def bounds(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Values that cut ``value`` into about equal ranges. They come to the driver, so that every use of them cuts alike."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = sorted(set(df.approxQuantile(value, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    return [b for b in found if abs(b) < float("inf")]


def placed(df: DataFrame, value: str, ends: Sequence[float]) -> DataFrame:
    if not ends:
        return df.withColumn(RANGE, F.lit(0.0))
    splits = [-float("inf"), *ends, float("inf")]
    found = Bucketizer(splits=splits, inputCol=value, outputCol=RANGE, handleInvalid="keep").transform(df)
    return found.withColumn(RANGE, F.coalesce(RANGE, F.lit(-1.0)))


def running(df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False, ties: Sequence[str] = (), ahead: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds ``c_before`` and ``c_all`` for each of ``sums``: its sum over the group's earlier rows, and over the group.

    Rows go by ``value``, then by ``ties``, which must leave no two rows equal in a group. ``c_next`` is added for each of
    ``ahead``: its value in the next row of the group, null in the last.
    """
    rows = cut(df, value, ranges)
    turn = F.desc if descending else F.asc
    order = [turn(value), *[F.asc(c) for c in ties]]
    inside = Window.partitionBy(*by, RANGE).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"{c}_before": F.sum(c).over(earlier) for c in sums} | {f"{c}_next": F.lead(c).over(inside) for c in ahead})
    ends = {f"{c}_before": f"_{c}_offset" for c in sums}
    place = F.struct(*[(-F.col(value) if descending else F.col(value)).alias("v"), *ties])
    totals = rows.groupBy(*by, RANGE).agg(*[F.sum(c).alias(c) for c in sums], *[F.min_by(F.col(c), place).alias(f"_{c}_first") for c in ahead])
    # At most ``ranges`` rows of a group.
    group = list(by) or [F.lit(0)]
    over = Window.partitionBy(*group).orderBy(turn(RANGE))
    before = totals.select(
        *by, RANGE, *[F.coalesce(F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}_offset") for c in sums],
        *[F.sum(c).over(Window.partitionBy(*group)).alias(f"{c}_all") for c in sums], *[F.lead(f"_{c}_first").over(over).alias(f"_{c}_after") for c in ahead],
    )
    out = local.join(before, [*by, RANGE])
    out = out.withColumns({name: F.coalesce(F.col(name), F.lit(0)) + F.col(offset) for name, offset in ends.items()})
    if ahead:
        # Sums of earlier rows tell which row is a range's last; there the next range goes on.
        out = out.withColumns({f"{c}_next": F.coalesce(f"{c}_next", f"_{c}_after") for c in ahead})
    return out.drop(RANGE, *ends.values(), *[f"_{c}_after" for c in ahead])


def numbered(df: DataFrame, value: Column, ties: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``_place``, the row's number in its group from 0, and ``_rows``, the group's size, in order of ``value`` and ``ties``."""
    rows = df.withColumns({"_value": value.cast("double"), "_one": F.lit(1)})
    return running(rows, "_value", ["_one"], by, ties=ties).withColumnsRenamed({"_one_before": "_place", "_one_all": "_rows"}).drop("_value", "_one")


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, q): exact quantiles of the values that are not null, between neighbours in proportion; values are first counted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    rows = running(counts, "_value", ["_n"], by)
    first, whole = F.col("_n_before"), F.col("_n_all")

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < first + F.col("_n")), F.col("_value")))

    spot = lambda p: (whole - 1) * F.lit(float(p))
    ends = [(at_rank(F.floor(spot(p))).alias(f"_low{i}"), at_rank(F.ceil(spot(p))).alias(f"_high{i}")) for i, p in enumerate(at)]
    per = rows.groupBy(*by).agg(F.max("_n_all").alias("n"), *[c for pair in ends for c in pair])
    part = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    values = [F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * part(p) for i, p in enumerate(at)]
    return per.select(*by, "n", F.array(*values).alias("q"))


def median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, median), exact."""
    return quantiles(df, value, [0.5], by).select(*by, "n", F.get("q", F.lit(0)).alias("median"))
