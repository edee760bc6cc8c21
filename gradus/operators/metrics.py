"""Quality of ordinal predictions. Every measure derives from one pre-aggregated table of confusion cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.scalars import REFERABLE_FROM, ratio, wilson
from gradus.operators.curves import auc, score_counts
from gradus.operators.ranges import median

GRADES = range(5)


def cells(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, p, n): the non-empty cells of each group's confusion matrix."""
    return df.groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def with_all(counted: DataFrame, by: str, name: str = "ALL") -> DataFrame:
    """Adds a group of all groups to pre-aggregated cells."""
    both = counted.withColumn(by, F.explode(F.array(F.col(by).cast("string"), F.lit(name))))
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


def dense(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All 25 cells of each group, empty ones with 0."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(4)))
    groups = counted.select(*by).distinct() if by else counted.sparkSession.range(1).select()
    full = groups.select(*by, grid.alias("t")).select(*by, "t", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("p"))
    return full.join(counted, [*by, "t", "p"], "left").select(*by, "t", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _sum(condition: Column, value: Column | None = None) -> Column:
    return F.sum(F.when(condition, F.col("n") if value is None else value).otherwise(0))


def qwk(counted: DataFrame, by: Sequence[str] = (), observed: bool = False) -> DataFrame:
    """(by, qwk): quadratic weighted kappa, null where only one label occurs.

    ``observed``: distances count places among the labels that a group's truths and predictions show, not grades.
    """
    i, j = F.col("t").cast("double"), F.col("p").cast("double")
    rows = counted
    if observed:
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        rows = counted.withColumn("labels", F.array_sort(F.array_union(F.collect_set("t").over(w), F.collect_set("p").over(w))))
        i, j = (F.array_position("labels", F.col(c)).cast("double") for c in "tp")
    n = F.col("n").cast("double")
    moments = rows.groupBy(*by).agg(
        F.sum(n).alias("w"), F.sum(n * i).alias("si"), F.sum(n * j).alias("sj"), F.sum(n * i * i).alias("sii"), F.sum(n * j * j).alias("sjj"), F.sum(n * (i - j) * (i - j)).alias("d"),
    )
    chance = F.col("sii") + F.col("sjj") - 2 * F.col("si") * F.col("sj") / F.col("w")
    return moments.select(*by, F.when(chance > 1e-9, 1 - F.col("d") / chance).alias("qwk"))


def grade_metrics(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, accuracy, macro_f1, recall_grade_0..4) from cells; an absent grade has a null recall and adds 0 to macro-F1's 5 terms."""
    t, p = F.col("t"), F.col("p")
    sums = [F.sum("n").alias("n"), _sum(t == p).alias("hit")]
    for g in GRADES:
        sums += [_sum((t == g) & (p == g)).alias(f"tp{g}"), _sum(t == g).alias(f"t{g}"), _sum(p == g).alias(f"p{g}")]
    f1 = sum((F.coalesce(ratio(2 * F.col(f"tp{g}"), F.col(f"t{g}") + F.col(f"p{g}")), F.lit(0.0)) for g in GRADES), F.lit(0.0)) / len(GRADES)
    recalls = [ratio(F.col(f"tp{g}"), F.col(f"t{g}")).alias(f"recall_grade_{g}") for g in GRADES]
    return counted.groupBy(*by).agg(*sums).select(*by, "n", ratio(F.col("hit"), F.col("n")).alias("accuracy"), f1.alias("macro_f1"), *recalls)


def referable_confusion(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fp, tn, fn, sensitivity, specificity, precision, referral_rate) of the rule grade >= 2."""
    t, p = F.col("t") >= REFERABLE_FROM, F.col("p") >= REFERABLE_FROM
    c = counted.groupBy(*by).agg(_sum(t & p).alias("tp"), _sum(~t & p).alias("fp"), _sum(~t & ~p).alias("tn"), _sum(t & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        "*", ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp + fp, tp + fp + tn + fn).alias("referral_rate"),
    )


def costly_errors(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, severe_total, severe_missed): truths of 3 and 4, and those predicted 0 or 1."""
    severe = F.col("t") >= 3
    return counted.groupBy(*by).agg(_sum(severe).alias("severe_total"), _sum(severe & (F.col("p") <= 1)).alias("severe_missed"))


def majority(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, majority_grade, majority_acc, share_no_dr): the commonest truth, ties to the smallest."""
    per = counted.groupBy(*by, "t").agg(F.sum("n").alias("n"))
    best = F.max_by("t", F.struct("n", -F.col("t")))
    return per.groupBy(*by).agg(best.alias("majority_grade"), ratio(F.max("n"), F.sum("n")).alias("majority_acc"), ratio(_sum(F.col("t") == 0), F.sum("n")).alias("share_no_dr"))


def stratified_report(df: DataFrame, truth: str, pred: str, by: str) -> DataFrame:
    """All measures for each stratum and for ALL, from one pass over the rows."""
    counted = with_all(cells(df, truth, pred, [by]), by)
    referral = referable_confusion(counted, [by]).select(by, "sensitivity", "specificity", "referral_rate")
    return grade_metrics(counted, [by]).join(qwk(counted, [by], observed=True), by).join(referral, by).join(majority(counted, [by]), by)


def per_class(counted: DataFrame) -> DataFrame:
    """(grade, n, recall, top_wrong, n_wrong): each true grade's commonest wrong prediction, ties to the smallest."""
    wrong = F.col("p") != F.col("t")
    best = F.max_by(F.when(wrong, F.col("p")), F.when(wrong, F.struct("n", -F.col("p"))))
    return counted.groupBy(F.col("t").alias("grade")).agg(
        F.sum("n").alias("n"), ratio(_sum(~wrong), F.sum("n")).alias("recall"), best.alias("top_wrong"), F.coalesce(F.max(F.when(wrong, F.col("n"))), F.lit(0)).alias("n_wrong")
    )


def referral_breakdown(counted: DataFrame) -> DataFrame:
    """Referral errors of each grade; the rate that does not apply to a grade, or an absent grade's, is null."""
    grid = counted.sparkSession.range(5).select(F.col("id").cast("int").alias("grade"))
    seen = counted.groupBy(F.col("t").alias("grade")).agg(F.sum("n").alias("n"), _sum(F.col("p") >= REFERABLE_FROM).alias("referred"))
    full = grid.join(seen, "grade", "left").na.fill(0, ["n", "referred"])
    ill = F.col("grade") >= REFERABLE_FROM
    return full.select(
        "grade", "n", "referred", (F.col("n") - F.col("referred")).alias("not_referred"), F.when(ill, F.col("n") - F.col("referred")).alias("missed_referable"),
        F.when(ill, ratio(F.col("referred"), F.col("n"))).alias("sensitivity"), F.when(~ill, ratio(F.col("referred"), F.col("n"))).alias("false_referral_fraction"),
    )


def paired_discordance(df: DataFrame, truth: str, baseline: str, candidate: str) -> DataFrame:
    """(grade, n, both_missed, baseline_only_missed, candidate_only_missed, neither_missed) of the referable grades and of all."""
    a, b = F.col(baseline) < REFERABLE_FROM, F.col(candidate) < REFERABLE_FROM
    grade = F.explode(F.array(F.concat(F.lit("grade_"), F.col(truth).cast("string")), F.lit("all_referable"))).alias("grade")
    ill = df.where(F.col(truth) >= REFERABLE_FROM).groupBy(truth, a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n")).select(grade, "a", "b", "n")
    a, b = F.col("a"), F.col("b")
    return ill.groupBy("grade").agg(
        F.sum("n").alias("n"), _sum(a & b).alias("both_missed"), _sum(a & ~b).alias("baseline_only_missed"), _sum(~a & b).alias("candidate_only_missed"), _sum(~a & ~b).alias("neither_missed")
    )


def class_weights(counted: DataFrame) -> DataFrame:
    """(grade, weight): N / (5 n) of each grade, 0 for an absent one."""
    grid = counted.sparkSession.range(5).select(F.col("id").cast("int").alias("grade"))
    per = counted.groupBy(F.col("t").alias("grade")).agg(F.sum("n").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    # One row of totals beside five grades.
    return grid.join(per, "grade", "left").crossJoin(F.broadcast(total)).select("grade", F.coalesce(F.try_divide(F.col("total").cast("double"), 5 * F.col("n")), F.lit(0.0)).alias("weight"))


def grade_counts(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, true_0..4, pred_0..4, healthy, healthy_referred): distributions of truth and prediction, and the slice of grade 0."""
    sums = [_sum(F.col(c) == g).alias(f"{name}_{g}") for c, name in (("t", "true"), ("p", "pred")) for g in GRADES]
    healthy = F.col("t") == 0
    return counted.groupBy(*by).agg(*sums, _sum(healthy).alias("healthy"), _sum(healthy & (F.col("p") >= REFERABLE_FROM)).alias("healthy_referred"))


def cohort_summary(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, referable, missed, severe_total, severe_missed, sensitivity, specificity and their Wilson limits) of the rule grade >= 2."""
    c = referable_confusion(counted, by).select(*by, "tp", "fp", "tn", "fn", "sensitivity", "specificity")
    low_high = lambda k, n, name: [wilson(k, n)[side].alias(f"{name}_{side}") for side in ("low", "high")]
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rows = c.select(*by, (tp + fp + tn + fn).alias("n"), (tp + fn).alias("referable"), fn.alias("missed"), "sensitivity", "specificity", *low_high(tp, tp + fn, "sensitivity"), *low_high(tn, tn + fp, "specificity"))
    severe = costly_errors(counted, by)
    return rows.join(severe, list(by)) if by else rows.crossJoin(severe)


def site_summary(df: DataFrame, truth: str, pred: str, raw: str, flag: str, by: str) -> DataFrame:
    """(by, n, auc, qwk, accuracy, macro_f1, moderate, moderate_below_2, median_without, median_with) by site.

    The last two are the median scores of grade-2 rows without and with ``flag``.
    """
    counted = cells(df, truth, pred, [by])
    area = auc(score_counts(df, F.col(truth) >= REFERABLE_FROM, raw, [by]), [by])
    two = F.col("t") == 2
    moderate = counted.groupBy(by).agg(_sum(two).alias("moderate"), ratio(_sum(two & (F.col("p") < 2)), _sum(two)).alias("moderate_below_2"))
    medians = median(df.where((F.col(truth) == 2) & F.col(flag).isNotNull()), raw, [by, flag])
    of = lambda value: F.max(F.when(F.col(flag) == value, F.col("median")))
    medians = medians.groupBy(by).agg(of(False).alias("median_without"), of(True).alias("median_with"))
    main = grade_metrics(counted, [by]).select(by, "n", "accuracy", "macro_f1")
    return main.join(area, by).join(qwk(counted, [by], observed=True), by).join(moderate, by).join(medians, by, "left")


def metric_block(df: DataFrame, truth: str, raw: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """All measures of scores and the grades made from them: AUC, grade metrics, referral."""
    counted = cells(df, truth, pred, by)
    parts = [qwk(counted, by, observed=True), referable_confusion(counted, by), auc(score_counts(df, F.col(truth) >= REFERABLE_FROM, raw, by), by)]
    out = grade_metrics(counted, by)
    for p in parts:
        out = out.join(p, list(by)) if by else out.crossJoin(p)
    return out


def missed_severe(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """The rows of grade 3 and 4 that were predicted 0 or 1."""
    return df.where((F.col(truth) >= 3) & (F.col(pred) <= 1))
