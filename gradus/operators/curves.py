"""Curves of a score against a binary truth. Rows are first counted by distinct score; running sums go over ranges of scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.scalars import odds, ratio, sigmoid
from gradus.operators.ranges import running


def score_counts(df: DataFrame, y: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg): rows of each class at each distinct score."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def roc_points(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, tp, fp, tpr, fpr, pos_all, neg_all, corner) at each distinct score, by descending score; rates are null for an absent class.

    ``corner`` marks the first and last point and those between which the curve bends: the next score adds other counts.
    """
    rows = running(counts, "score", ["pos", "neg"], by, descending=True, ahead=["pos", "neg"])
    first, last = F.col("pos_before") + F.col("neg_before") == 0, F.col("pos_next").isNull()
    bends = (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg"))
    rows = rows.select(
        *by, "score", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"), "pos_all", "neg_all", (first | last | bends).alias("corner")
    )
    return rows.withColumns({"tpr": ratio(F.col("tp"), F.col("pos_all")), "fpr": ratio(F.col("fp"), F.col("neg_all"))})


def roc_corners(points: DataFrame) -> DataFrame:
    """The first and last point and those between which the curve bends; all of them where a group has at most two."""
    return points.where("corner").drop("corner")


def auc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc): the chance that a positive outscores a negative, ties half; null for an absent class."""
    rows = running(counts, "score", ["neg"], by)
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    return rows.groupBy(*by).agg(ratio(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def average_precision(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, average_precision): the sum of precision times the step of recall, by descending score."""
    rows = running(counts, "score", ["pos", "neg"], by, descending=True)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    part = ratio(F.col("pos"), F.col("pos_all")) * ratio(tp, tp + fp)
    return rows.groupBy(*by).agg(F.sum(part).alias("average_precision"))


def operating_point(counts: DataFrame, by: Sequence[str] = (), min_sensitivity: float = 0.9) -> DataFrame:
    """(by, cut, sensitivity, specificity): the highest corner of the curve whose sensitivity reaches the bar."""
    if not 0 < min_sensitivity <= 1:
        raise ValueError(f"no sensitivity can be {min_sensitivity}: it is above 0 and at most 1")
    able = roc_corners(roc_points(counts, by)).where(F.col("tpr") >= min_sensitivity)
    best = able.groupBy(*by).agg(F.max_by(F.struct("score", "tpr", "fpr"), "score").alias("x"))
    return best.select(*by, F.col("x.score").alias("cut"), F.col("x.tpr").alias("sensitivity"), (1 - F.col("x.fpr")).alias("specificity"))


def apply_cut(df: DataFrame, y: Column, score: str, cut: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, tp, fp, tn, fn, sensitivity, specificity, ppv, referral_rate) of the rule score >= cut."""
    flag = F.col(score) >= cut
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(y & flag).alias("tp"), F.count_if(~y & flag).alias("fp"), F.count_if(~y & ~flag).alias("tn"), F.count_if(y & ~flag).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("*", ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("ppv"), ratio(tp + fp, F.col("n")).alias("referral_rate"))


def bin_edges(bins: int = 10) -> list[float]:
    return [float(e) for e in np.linspace(0, 1, bins + 1)]


def in_bin(p: Column, bins: int = 10) -> Column:
    """The bin of a probability: the number of inner edges below it."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in bin_edges(bins)[1:-1]]), lambda e: p > e))


def reliability(df: DataFrame, y: Column, prob: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_predicted, observed, gap): bins (low, high], the first closed; empty ones are left out."""
    rows = df.select(*by, F.col(prob).alias("p"), y.cast("double").alias("y"), in_bin(F.col(prob), bins).alias("bin"))
    return rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed")).withColumn("gap", F.col("observed") - F.col("mean_predicted"))


def ece(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ece) of a reliability table."""
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def decision_curve(df: DataFrame, y: Column, prob: str, by: Sequence[str] = (), thresholds: Sequence[float] | None = None) -> DataFrame:
    """(by, threshold, model, treat_all, treat_none, model_beats_both): net benefit of acting at each threshold.

    A row counts towards all thresholds at or below its probability, so one pass over the rows counts how many those are.
    """
    at = [float(t) for t in (np.arange(0.05, 0.75, 0.05) if thresholds is None else thresholds)]
    if not at or any(not 0 < t < 1 for t in at) or at != sorted(set(at)):
        raise ValueError("thresholds must increase strictly between 0 and 1")
    cuts = F.array(*[F.lit(t) for t in at])
    reached = df.groupBy(*by, F.size(F.filter(cuts, lambda t: F.col(prob) >= t)).alias("reached")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    rows = reached.select(*by, "reached", "pos", "neg", F.posexplode(cuts).alias("k", "threshold"))
    acts = F.col("reached") > F.col("k")
    sums = rows.groupBy(*by, "threshold").agg(
        F.sum(F.when(acts, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(acts, F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"),
    )
    o, share = odds(F.col("threshold")), F.col("pos") / F.col("n")
    out = sums.select(*by, "threshold", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * o).alias("model"), (share - (1 - share) * o).alias("treat_all"), F.lit(0.0).alias("treat_none"))
    return out.withColumn("model_beats_both", (F.col("model") > F.col("treat_all")) & (F.col("model") > 0))


def calibration_in_the_large(df: DataFrame, y: Column, prob: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg((F.avg(y.cast("double")) - F.avg(prob)).alias("observed_minus_predicted"))


def calibrated_transfer(df: DataFrame, y: Column, score: str, by: str, base: tuple[float, float], fitted: DataFrame, bins: int = 10) -> DataFrame:
    """(fitted_on, applied_to, ece_base, ece_refitted): each site's calibrator (``fitted``: by, slope, intercept) on every other site.

    ``base`` is the slope and intercept of the calibrator in use. Scores are counted first, so sites meet counts, not rows.
    """
    counts = score_counts(df, y, score, [by]).withColumnRenamed(by, "applied_to")
    # A row for each site.
    pairs = counts.join(F.broadcast(fitted.withColumnRenamed(by, "fitted_on")), F.col("applied_to") != F.col("fitted_on"))
    keys = ["fitted_on", "applied_to"]

    def error(p: Column, name: str) -> DataFrame:
        rows = pairs.withColumns({"_p": p, "_bin": in_bin(p, bins), "_n": F.col("pos") + F.col("neg")})
        per = rows.groupBy(*keys, "_bin").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_p")).alias("said"), F.sum("pos").alias("seen"))
        return per.groupBy(*keys).agg((F.sum(F.abs(F.col("seen") - F.col("said"))) / F.sum("n")).alias(name))

    refitted = error(sigmoid(F.col("slope") * F.col("score") + F.col("intercept")), "ece_refitted")
    return error(sigmoid(F.lit(base[0]) * F.col("score") + F.lit(base[1])), "ece_base").join(refitted, keys)


def site_transfer(df: DataFrame, y: Column, score: str, by: str, min_sensitivity: float = 0.9) -> DataFrame:
    """(fitted_on, applied_to, cut, sensitivity, specificity): each site's cut on every other site's rows.

    Sites' confusions at a cut come from counts by score, joined to one cut per site: dozens of sites, not rows, are paired.
    """
    counts = score_counts(df, y, score, [by])
    cuts = operating_point(counts, [by], min_sensitivity).select(F.col(by).alias("fitted_on"), "cut")
    # A row for each site.
    pairs = counts.withColumnRenamed(by, "applied_to").join(F.broadcast(cuts), F.col("applied_to") != F.col("fitted_on"))
    flag = F.col("score") >= F.col("cut")
    part = lambda c, f: F.sum(F.when(f, F.col(c)).otherwise(0))
    return pairs.groupBy("fitted_on", "applied_to", "cut").agg(ratio(part("pos", flag), F.sum("pos")).alias("sensitivity"), ratio(part("neg", ~flag), F.sum("neg")).alias("specificity"))
