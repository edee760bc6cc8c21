"""Rank tests, the t-test, Platt scaling, thresholds and a metadata forest."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.scalars import CUTS, sigmoid
from gradus.operators.ranges import running


def mid_ranks(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, n, rank): the mid-rank of each distinct value, by running sums over ranges of distinct values."""
    per = df.groupBy(F.col(value).alias("value"), F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    ties = per.groupBy("value").agg(F.sum("n").alias("ties"))
    ranks = running(ties, "value", ["ties"]).select("value", "ties", (F.col("ties_before") + (F.col("ties") + 1) / 2).alias("rank"))
    return per.join(ranks, "value")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """(h, groups): Kruskal and Wallis' H with the correction for ties."""
    ranked = mid_ranks(df, value, group)
    per = ranked.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n")).alias("r"))
    h = per.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.count(F.lit(1)).alias("groups"))
    t = F.col("ties").cast("double")
    ties = ranked.select("value", "ties").distinct().agg(F.sum(t * t * t - t).alias("t"))
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    # One row beside one row.
    return h.crossJoin(ties).select(F.try_divide(raw, 1 - F.col("t") / (n * n * n - n)).alias("h"), "groups")


def mann_whitney(df: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """(u, n1, n2, z, spread, tied): U of the group ``first`` against the rest and its normal approximation with ties."""
    ranked = mid_ranks(df, value, group)
    mine = F.col("group") == first
    s = ranked.agg(
        F.sum(F.when(mine, F.col("rank") * F.col("n"))).alias("r"), F.sum(F.when(mine, F.col("n")).otherwise(0)).cast("double").alias("n1"), F.sum(F.when(mine, 0).otherwise(F.col("n"))).cast("double").alias("n2"),
    )
    t = F.col("ties").cast("double")
    ties = ranked.select("value", "ties").distinct().agg(F.sum(t * t * t - t).alias("t"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("t") / (n * (n - 1))))
    return s.crossJoin(ties).select(u.alias("u"), n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), F.try_divide(u - n1 * n2 / 2, spread).alias("z"), spread.alias("spread"), (F.col("t") > 0).alias("tied"))


def paired_t(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean_diff, sd_diff, t, won): the paired t statistic of b - a and the pairs in which b is larger."""
    d = F.col(b) - F.col(a)
    s = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), F.count_if(d > 0).alias("won"))
    return s.withColumn("t", F.try_divide(F.col("mean_diff") * F.sqrt(F.col("n").cast("double")), F.col("sd_diff")))


def chi2_sf(x: float, df: int) -> float:
    """P(X > x) of a chi-squared variable: the regularised upper incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= (step := d * c)
        if abs(step - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: int) -> float:
    """Two-sided P(|T| > |t|) of Student's t with ``df`` degrees of freedom, by Simpson's rule on the angle."""
    limit = math.atan(abs(t) / math.sqrt(df))
    theta = np.linspace(0, limit, 20_001)
    f = np.cos(theta) ** (df - 1)
    area = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (theta[1] - theta[0]) / 3
    return max(0.0, 1 - 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * area)


def platt(df: DataFrame, y: Column, score: str, by: Sequence[str] = (), rounds: int = 50) -> DataFrame:
    """(by, slope, intercept): the logistic calibration of each group, with an L2 penalty of C = 1 on the slope and a free intercept.

    Newton steps from zero on the counts of each score; a step needs five sums of a group, so that is all the driver sees.
    """
    spark, keys = df.sparkSession, list(by)
    counts = df.groupBy(*keys, F.col(score).cast("double").alias("_x")).agg(F.count_if(y).alias("_pos"), F.count(F.lit(1)).alias("_n")).persist()
    schema = counts.select(*keys).schema.add("slope", "double").add("intercept", "double")
    fitted = {tuple(r): (0.0, 0.0) for r in counts.select(*keys).distinct().collect()} if keys else {(): (0.0, 0.0)}  # a row for each group
    table = lambda: spark.createDataFrame([(*k, *w) for k, w in fitted.items()], schema)
    for _ in range(rounds):
        rows = counts.join(F.broadcast(table()), keys) if keys else counts.crossJoin(F.broadcast(table()))
        p, n, x = sigmoid(F.col("slope") * F.col("_x") + F.col("intercept")), F.col("_n"), F.col("_x")
        off, weight = n * p - F.col("_pos"), n * p * (1 - p)
        sums = [F.sum(c).alias(name) for name, c in (("g0", off * x), ("g1", off), ("h00", weight * x * x), ("h01", weight * x), ("h11", weight))]
        moved = 0.0
        for r in rows.groupBy(*keys).agg(*sums).collect():
            group = tuple(r[k] for k in keys)
            slope, intercept = fitted[group]
            step = np.linalg.solve([[r.h00 + 1, r.h01], [r.h01, r.h11]], [r.g0 + slope, r.g1])
            fitted[group] = (slope - float(step[0]), intercept - float(step[1]))
            moved = max(moved, *np.abs(step).tolist())
        if moved < 1e-13:
            break
    counts.unpersist()
    return table()


# The search's steps in their order, its rounds, and the gap that cuts must exceed.
STEPS, ROUNDS, LEAST_GAP = (-0.12, -0.04, 0.04, 0.12), 60, 0.05


def observed_kappa(table: np.ndarray) -> float:
    """Quadratic weighted kappa of a matrix of counts, over the labels that it shows; NaN where only one occurs."""
    shown = np.flatnonzero(table.sum(0) + table.sum(1))
    seen = table[np.ix_(shown, shown)].astype(float)
    weights = np.subtract.outer(np.arange(len(shown)), np.arange(len(shown))) ** 2
    chance = (weights * np.outer(seen.sum(1), seen.sum(0))).sum() / seen.sum()
    return 1 - (weights * seen).sum() / chance if chance else float("nan")


def optimise_cuts(df: DataFrame, truth: str, score: str, start: Sequence[float] = CUTS) -> tuple[list[float], float]:
    """Cuts that raise quadratic weighted kappa by coordinate search, and the kappa.

    A round tries each step on each cut in turn and keeps it if kappa rises. All values that a cut can take in a round are
    known before it, so one job counts the rows of each grade between them, and the round is played on those counts.
    """
    grades = len(start) + 1
    counts = df.groupBy(F.col(score).cast("double").alias("_x"), F.col(truth).cast("int").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).persist()
    cuts, best = [float(c) for c in start], None
    for _ in range(ROUNDS):
        marks = sorted({v for c in cuts for v in _reachable(c)})
        placed = Bucketizer(splits=[-float("inf"), *marks, float("inf")], inputCol="_x", outputCol="_at").transform(counts)
        seen = np.zeros((len(marks) + 1, grades), np.int64)
        for r in placed.groupBy("_at", "_t").agg(F.sum("_n").alias("n")).collect():  # a row for each mark and grade
            seen[int(r["_at"]), r["_t"]] = r.n
        below = np.concatenate([np.zeros((1, grades), np.int64), np.cumsum(seen, axis=0)])

        def kappa(tried: list[float]) -> float:
            ends = [0, *[bisect_left(marks, c) + 1 for c in tried], len(marks) + 1]
            return observed_kappa(np.stack([below[b] - below[a] for a, b in zip(ends, ends[1:], strict=False)], axis=1))

        best = kappa(cuts) if best is None else best
        before = cuts
        for i in range(len(cuts)):
            for step in STEPS:
                tried = [c + step if k == i else c for k, c in enumerate(cuts)]
                if min(b - a for a, b in zip(tried, tried[1:], strict=False)) > LEAST_GAP and (found := kappa(tried)) > best:
                    cuts, best = tried, found
        if cuts == before:
            break
    counts.unpersist()
    return cuts, best


def _reachable(cut: float) -> list[float]:
    """The values that a cut can have in a round: each step in turn is taken or not."""
    values = [cut]
    for step in STEPS:
        values += [v + step for v in values]
    return values


def mann_whitney_p(u: float, n1: int, n2: int, z: float, spread: float, tied: bool) -> float:
    """Two-sided p-value of U: exact for a sample of at most 8 without ties, else normal with a correction for continuity."""
    if min(n1, n2) <= 8 and not tied and n1 * n2 <= 100_000:
        ways = np.zeros((n1 + 1, n1 * n2 + 1))
        ways[0, 0] = 1
        for j in range(1, n1 + n2 + 1):  # subsets of ranks by their number and U
            for k in range(min(j, n1), 0, -1):
                shift = j - k
                ways[k, shift:] += ways[k - 1, : n1 * n2 + 1 - shift] if shift else ways[k - 1]
        upper = max(u, n1 * n2 - u)
        return float(min(1.0, 2 * ways[n1, math.ceil(upper - 1e-9) :].sum() / ways[n1].sum()))
    return float(math.erfc(max(0.0, abs(z) - 0.5 / spread) / math.sqrt(2))) if spread > 0 else 1.0


def with_p(df: DataFrame, name: str, p_value, *columns: str) -> DataFrame:
    """Adds a p-value computed by a plain function, for tables of a row for each test; null where an argument is."""

    @F.pandas_udf("double")
    def tail(values: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in r) else p_value(*r) for r in values.itertuples(index=False)], dtype="float64")

    return df.withColumn(name, tail(F.struct(*columns)))


#: Rows of a partition of a forest's input, about: a tree's count of a row is kept for each row and tree, 800 bytes of 200 trees.
SHARE = 1 << 16


def _vectors(df: DataFrame, features: Sequence[str], grade: str, *keep: str) -> DataFrame:
    """(label, keep, features) of the rows in which no feature and no grade is null, dealt to all cores in about equal shares.

    Tables of a few columns come in fewer parts than there are cores, and every level of every tree walks over all rows.
    """
    numbers = [F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)]
    rows = df.dropna(subset=[*features, grade]).select(F.col(grade).cast("double").alias("label"), *keep, *numbers)
    cores = df.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartition(max(-(-df.count() // SHARE), cores))
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features").transform(dealt).select("label", *keep, "features")


#: Depth of trees, which may be up to 30, and the share of all rows that a leaf has at least. Trees are held by the driver: of
#: depth 30 they grow until their leaves are pure or hold that share, so a tree has at most 1 / LEAF leaves, however many rows there
#: are. Each level is a job over all rows, and its statistics grow with the nodes.
DEPTH, LEAF = 5, 1e-4


def _forest(trees: int, seed: int, depth: int, leaf: float) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=depth, minWeightFractionPerNode=leaf)


def metadata_forest(
    df: DataFrame, features: Sequence[str], grade: str, fold: str, by: Sequence[str] = (), trees: int = 200, seed: int = 0, depth: int = DEPTH, leaf: float = LEAF
) -> DataFrame:
    """(by, t, p, n): cells of out-of-fold predictions of a forest that sees metadata only. High agreement reveals a shortcut.

    The cells are counted here, so that the rows kept for all folds can go; they come to the driver, one for each group and pair of grades.
    """
    rows, cells = _vectors(df, features, grade, fold, *by).persist(), []
    schema = rows.select(*by).schema.add("t", "integer").add("p", "integer").add("n", "long")
    for k in [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]:  # a row for each fold
        model = _forest(trees, seed, depth, leaf).fit(rows.where(F.col(fold) != k))
        predicted = model.transform(rows.where(F.col(fold) == k))
        part = predicted.groupBy(*by, F.col("label").cast("int").alias("t"), F.col("prediction").cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
        cells += map(tuple, part.collect())
    rows.unpersist()
    return df.sparkSession.createDataFrame(cells, schema).groupBy(*by, "t", "p").agg(F.sum("n").alias("n"))


def feature_importances(df: DataFrame, features: Sequence[str], grade: str, trees: int = 200, seed: int = 0, depth: int = DEPTH, leaf: float = LEAF) -> DataFrame:
    """(feature, importance) of a forest on all rows, the greatest first."""
    model = _forest(trees, seed, depth, leaf).fit(_vectors(df, features, grade))
    rows = list(zip(features, map(float, model.featureImportances.toArray()), strict=True))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
