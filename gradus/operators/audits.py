"""Re-derivation of reported numbers: sweeps, best epochs, fingerprints, cohort distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators.metrics import cells, costly_errors, grade_metrics, qwk, referable_confusion

#: Tolerances of reported means and deviations, and of recomputed scores.
REPORTED, RELATIVE, ABSOLUTE = 5e-5, 1e-7, 1e-8


def close(a: Column, b: Column, relative: float = RELATIVE, absolute: float = ABSOLUTE) -> Column:
    """Equal within tolerance; two nulls are equal, one is not."""
    near = F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(near, a.isNull() & b.isNull())


def fold_summary(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(by, folds, metric_mean, metric_std): the sample deviation is 0 for one fold."""
    stats = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))]
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *stats)


def sweep_audit(folds: DataFrame, summaries: DataFrame, by: Sequence[str], metric: str, tolerance: float = REPORTED) -> DataFrame:
    """Each summary beside its folds: whether folds run from 1 to k without repeats, and mean and deviation agree.

    Summaries without folds and folds without a summary show as rows that fail.
    """
    f = F.col("fold")
    seen = folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"), ((F.min(f) == 1) & (F.max(f) == F.count(f)) & (F.countDistinct(f) == F.count(f))).alias("contiguous"),
        F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"),
    )
    both = seen.join(summaries.select(*by, F.col("mean").alias("reported_mean"), F.col("std").alias("reported_std")), list(by), "full_outer")
    agrees = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
    ok = F.coalesce(F.col("contiguous"), F.lit(False)) & agrees("mean", "reported_mean") & agrees("std", "reported_std")
    return both.withColumn("passed", ok)


def best_epoch(history: DataFrame, by: Sequence[str], patience: int) -> DataFrame:
    """(by, best_epoch, best, stopped_at): the first strict maximum, where training stops after ``patience`` epochs without one.

    ``history`` has epoch and value. Epochs after the stop do not count.
    """
    w = Window.partitionBy(*by).orderBy("epoch")
    record = F.coalesce(F.col("value") > F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = history.withColumn("record", record).withColumn("last", F.max(F.when(F.col("record"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("stop", F.min(F.when(F.col("epoch") - F.col("last") >= patience, F.col("epoch"))).over(Window.partitionBy(*by)))
    used = rows.where(F.col("stop").isNull() | (F.col("epoch") <= F.col("stop")))
    return used.groupBy(*by).agg(F.max_by("epoch", F.when(F.col("record"), F.struct("value", -F.col("epoch")))).alias("best_epoch"), F.max("value").alias("best"), F.max("epoch").alias("stopped_at"))


def fingerprint(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(rows, fingerprint) of a table, whatever the order of its rows.

    Each row's SHA-256 is taken as eight 32-bit words; words are added up over the rows, and the sums are hashed. Sums combine
    before the shuffle, so no task gathers rows.
    """
    text = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    hashed = df.select(F.sha2(F.concat_ws(";", *[text(c) for c in (key, *columns)]), 256).alias("h"))
    word = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = hashed.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(word(i)), F.lit(0)).cast("string").alias(f"w{i}") for i in range(8)])
    return sums.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[f"w{i}" for i in range(8)]), 256).alias("fingerprint"))


def distribution_audit(reports: DataFrame) -> DataFrame:
    """Adds ``consistent`` to (n, referable, counts map<string,long>): counts sum to n, and to referable from grade 2 on."""
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    high = F.map_filter("counts", lambda k, v: k.cast("int") >= 2)
    return reports.withColumn("consistent", (add(F.map_values("counts")) == F.col("n")) & (add(F.map_values(high)) == F.col("referable")))


def counts_from_rates(rate: Column, n: Column, tolerance: float = 1e-6) -> Column:
    """The whole number that a published rate of ``n`` stands for, or null if there is none."""
    k = F.round(rate * n)
    return F.when(F.abs(rate * n - k) <= tolerance, k.cast("long"))


def same(recorded: DataFrame, found: DataFrame, by: Sequence[str], relative: float = RELATIVE, absolute: float = ABSOLUTE) -> DataFrame:
    """(by, recorded, found, matches) of two long tables (by, value); what only one of them has does not match."""
    a, b = (df.select(*by, F.col("value").cast("double").alias(name), F.lit(True).alias(f"_{name}")) for df, name in ((recorded, "recorded"), (found, "found")))
    both = a.join(b, list(by), "full_outer")
    there = F.col("_recorded").isNotNull() & F.col("_found").isNotNull()
    return both.select(*by, "recorded", "found", (there & close(F.col("recorded"), F.col("found"), relative, absolute)).alias("matches"))


def long(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(by, metric, value) from a column for each metric."""
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(*by, F.explode(F.array(*entries)).alias("m")).select(*by, "m.metric", "m.value")


def fold_means(scores: DataFrame, key: str, truth: str, fold: str = "fold") -> DataFrame:
    """(key, truth, raw): the mean of the folds' scores, which are added in order of folds: a mean that is at a cut is on the same side of it, however rows are dealt."""
    each = F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct(fold, "raw"))))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x["raw"])
    return scores.groupBy(key, truth).agg(F.try_divide(total, F.size(each)).alias("raw"))


def sweep_metrics(scores: DataFrame, cuts: DataFrame, key: str, truth: str) -> DataFrame:
    """(fold, n, qwk, accuracy, macro_f1, sensitivity, specificity, severe_missed) of each fold and of the ensemble, as fold 0.

    ``scores`` has fold, key, truth and raw; ``cuts`` (fold, cuts) one array for each fold. The ensemble averages scores and
    cuts over the folds first and grades once.
    """
    mean_cut = cuts.select(F.posexplode("cuts").alias("k", "c")).groupBy("k").agg(F.avg("c").alias("c"))
    mean_cuts = mean_cut.agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("kc")).select(F.lit(0).alias("fold"), F.col("kc.c").alias("cuts"))
    ensemble = fold_means(scores, key, truth).select(F.lit(0).alias("fold"), truth, "raw")
    rows = scores.select(F.col("fold").cast("int").alias("fold"), truth, "raw").unionByName(ensemble)
    every = cuts.select(F.col("fold").cast("int").alias("fold"), "cuts").unionByName(mean_cuts)
    # A row for each fold.
    graded = rows.join(F.broadcast(every), "fold").withColumn("pred", F.size(F.filter("cuts", lambda c: c <= F.col("raw"))))
    counted = cells(graded, truth, "pred", ["fold"])
    referral = referable_confusion(counted, ["fold"]).select("fold", "sensitivity", "specificity")
    severe = costly_errors(counted, ["fold"]).select("fold", "severe_missed")
    main = grade_metrics(counted, ["fold"]).select("fold", "n", "accuracy", "macro_f1")
    return main.join(qwk(counted, ["fold"], observed=True), "fold").join(referral, "fold").join(severe, "fold")


def reconstructed(reports: DataFrame, by: str) -> DataFrame:
    """Counts behind published rates: (by, n, referable, tp, fn, tn, fp, consistent).

    ``reports`` has n, prevalence, sensitivity, specificity, ppv and referral_rate. Counts are null where a rate stands for
    no whole number; ``consistent`` needs all of them, both classes, and rates that follow from the counts.
    """
    ill = counts_from_rates(F.col("prevalence"), F.col("n"))
    rows = reports.withColumn("referable", ill)
    rows = rows.withColumns({"tp": counts_from_rates(F.col("sensitivity"), F.col("referable")), "tn": counts_from_rates(F.col("specificity"), F.col("n") - F.col("referable"))})
    rows = rows.withColumns({"fn": F.col("referable") - F.col("tp"), "fp": F.col("n") - F.col("referable") - F.col("tn")})
    flagged = F.col("tp") + F.col("fp")
    agrees = lambda rate, part, whole: F.abs(F.col(rate) - F.try_divide(part.cast("double"), whole)) <= ABSOLUTE
    ok = (F.col("referable") > 0) & (F.col("referable") < F.col("n")) & agrees("referral_rate", flagged, F.col("n")) & agrees("ppv", F.col("tp"), flagged)
    return rows.select(by, "n", "referable", "tp", "fn", "tn", "fp", F.coalesce(ok, F.lit(False)).alias("consistent"))


def rule_comparison(raw: DataFrame, grade: DataFrame, by: str) -> DataFrame:
    """(by, n, referable, grade_missed, raw_missed, difference, comparable): two referral rules' reports of the same cohorts, side by side.

    ``raw`` comes from ``reconstructed``; ``grade`` has n, referable and missed. Cohorts that only one side reports, or of
    other sizes, are not comparable.
    """
    both = raw.select(by, "n", "referable", F.col("fn").alias("raw_missed")).join(
        grade.select(by, F.col("n").alias("_n"), F.col("referable").alias("_referable"), F.col("missed").alias("grade_missed")), by, "full_outer"
    )
    comparable = F.coalesce((F.col("n") == F.col("_n")) & (F.col("referable") == F.col("_referable")), F.lit(False))
    return both.select(by, "n", "referable", "grade_missed", "raw_missed", (F.col("raw_missed") - F.col("grade_missed")).alias("difference"), comparable.alias("comparable"))


def fold_completeness(folds: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(by, folds, rows, missing, complete): which of the folds 1 to k each sweep has; complete ones have all, with equally many rows."""
    per = folds.groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("n"))
    seen = per.groupBy(*by).agg(F.array_sort(F.collect_set("fold")).alias("seen"), F.sum("n").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(k)), F.col("seen").cast("array<int>"))
    return seen.select(*by, F.size("seen").cast("long").alias("folds"), "rows", F.size(missing).cast("long").alias("missing"), ((F.size(missing) == 0) & (F.col("low") == F.col("high"))).alias("complete"))


def signature_check(recorded: DataFrame, found: DataFrame, key: str, signature: str) -> DataFrame:
    """(state, n) of the files of two listings: same, changed, missing, added."""
    a, b = (df.select(key, F.col(signature).alias(name)) for df, name in ((recorded, "_was"), (found, "_is")))
    both = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), key, "full_outer")
    state = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "added").when(F.col("_was").eqNullSafe(F.col("_is")), "same").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def summary_with_ensemble(rows: DataFrame) -> DataFrame:
    """(metric, folds, mean, std, ensemble, gain) of long rows (fold, metric, value), in which fold 0 is the ensemble."""
    of_fold, of_all = F.when(F.col("fold") > 0, F.col("value")), F.when(F.col("fold") == 0, F.col("value"))
    return rows.groupBy("metric").agg(
        F.count(of_fold).alias("folds"), F.avg(of_fold).alias("mean"), F.coalesce(F.stddev_samp(of_fold), F.lit(0.0)).alias("std"),
        F.max(of_all).alias("ensemble"), (F.max(of_all) - F.avg(of_fold)).alias("gain"),
    )
