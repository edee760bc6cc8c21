"""Queries that put operators together: audits of reports, comparisons, contracts, splits; with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions import scalars as S
from gradus.operators import audits, checks, curves, joins, metrics, quality, resample, splits, stats
from gradus.operators.ranges import numbered
from gradus.plans.adapters import COHORTS_SQL, DIGIT_SQL, DOCS_SQL, EYES_SQL, PREDS_SQL, RUNS_SQL, cohorts, docs, eyes, noisy, preds, runs, table
from gradus.plans.shared import CURVE, DRAWN, DRAWS, GRADE, LIMITS, METRICS, POINT, REFERABLE, counts_of, fit_sql, graded, ill, kappa_sql, resampled_sums
from gradus.plans.registry import query
from gradus.sources.images import concentration, concentration_by, draw_spread

# ---------------------------------------------------------------- operating points and transfer

_APPLIED = """applied AS (SELECT cohort, count(*) AS n, count(*) FILTER (diagnosis >= 2 AND baseline_raw >= 1.25) AS tp,
    count(*) FILTER (diagnosis < 2 AND baseline_raw >= 1.25) AS fp, count(*) FILTER (diagnosis < 2 AND baseline_raw < 1.25) AS tn,
    count(*) FILTER (diagnosis >= 2 AND baseline_raw < 1.25) AS fn, count(*) FILTER (diagnosis >= 2 AND pred < 2) AS missed FROM cohorts GROUP BY cohort)"""


def _published(spark, d) -> DataFrame:
    """What a report would say of each cohort at a cut; the last cohort's positive predictive value is wrong."""
    a = curves.apply_cut(cohorts(spark, d), ill(), "baseline_raw", F.lit(1.25), ["cohort"])
    wrong = F.when(F.col("cohort") == F.max("cohort").over(Window.partitionBy(F.lit(0))), 0.001).otherwise(0.0)
    prevalence = S.ratio(F.col("tp") + F.col("fn"), F.col("n"))
    return a.select("cohort", "n", prevalence.alias("prevalence"), "sensitivity", "specificity", (F.col("ppv") + wrong).alias("ppv"), "referral_rate")


@query(f"""WITH {COHORTS_SQL}, {_APPLIED} SELECT cohort, n, tp + fn AS referable, tp, fn, tn, fp,
    cohort <> (SELECT max(cohort) FROM applied) AS consistent FROM applied""")
def reported_confusions(spark, d):
    return audits.reconstructed(_published(spark, d), "cohort")


@query(f"""WITH {COHORTS_SQL}, {_APPLIED} SELECT cohort, n, tp + fn AS referable, missed AS grade_missed, fn AS raw_missed, fn - missed AS difference,
    n = n + CAST(cohort = 'AMERICA' AS INTEGER) AS comparable FROM applied""")
def operating_point_audit(spark, d):
    """One cohort's grade report counts an eye too many, and so can't be compared."""
    grade = metrics.cohort_summary(metrics.cells(graded(cohorts(spark, d)), "diagnosis", "pred", ["cohort"]), ["cohort"])
    grade = grade.withColumn("n", F.col("n") + (F.col("cohort") == "AMERICA").cast("int"))
    return audits.rule_comparison(audits.reconstructed(_published(spark, d), "cohort"), grade, "cohort")


@query(f"""WITH {COHORTS_SQL}, {POINT}, {_APPLIED}, moved AS (SELECT p.cohort AS fitted_on, k.cohort AS applied_to, cut,
        sum(pos) FILTER (score >= cut)::DOUBLE / sum(pos) AS sensitivity, coalesce(sum(neg) FILTER (score < cut), 0)::DOUBLE / sum(neg) AS specificity
        FROM point p JOIN k ON p.cohort <> k.cohort GROUP BY ALL)
    SELECT fitted_on, applied_to, cut, sensitivity - tp::DOUBLE / (tp + fn) AS sensitivity_delta, specificity - tn::DOUBLE / (tn + fp) AS specificity_delta
    FROM moved JOIN applied ON cohort = applied_to""")
def transfer_deltas(spark, d):
    rows = cohorts(spark, d)
    moved = curves.site_transfer(rows, ill(), "baseline_raw", "cohort")
    base = curves.apply_cut(rows, ill(), "baseline_raw", F.lit(1.25), ["cohort"])
    base = base.select(F.col("cohort").alias("applied_to"), F.col("sensitivity").alias("_sensitivity"), F.col("specificity").alias("_specificity"))
    delta = lambda c: (F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta")
    return moved.join(base, "applied_to").select("fitted_on", "applied_to", "cut", delta("sensitivity"), delta("specificity"))


_EDGES = ", ".join(repr(e) for e in curves.bin_edges()[1:-1])


def _ece_sql(slope: str, intercept: str, name: str) -> str:
    return f"""{name} AS (SELECT fitted_on, applied_to, sum(abs(seen - said)) / sum(n) AS {name} FROM (
        SELECT fitted_on, applied_to, len(list_filter([{_EDGES}]::DOUBLE[], lambda e: p > e)) AS bin, sum(n) AS n, sum(n * p) AS said, sum(pos) AS seen FROM (
            SELECT fitted_on, applied_to, pos, pos + neg AS n, 1 / (1 + exp(-({slope} * score + {intercept}))) AS p FROM pairs) GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {COHORTS_SQL}, k AS (SELECT cohort, baseline_raw AS score, count(*) FILTER (diagnosis >= 2) AS pos, count(*) FILTER (diagnosis < 2) AS neg
        FROM cohorts GROUP BY ALL), {fit_sql("k", "cohort")},
    pairs AS (SELECT f.cohort AS fitted_on, k.cohort AS applied_to, slope, intercept, score, pos, neg FROM fitted f JOIN k ON f.cohort <> k.cohort),
    {_ece_sql("1.5::DOUBLE", "(-2.25::DOUBLE)", "ece_base")}, {_ece_sql("slope", "intercept", "ece_refitted")}
    SELECT * FROM ece_base JOIN ece_refitted USING (fitted_on, applied_to)""")
def site_calibration(spark, d):
    rows = cohorts(spark, d)
    return curves.calibrated_transfer(rows, ill(), "baseline_raw", "cohort", (1.5, -2.25), stats.platt(rows, ill(), "baseline_raw", ["cohort"]))


@query(f"""WITH {COHORTS_SQL}, {POINT}, p AS (SELECT cohort, sum(pos * ((na - fp) + neg / 2.0::DOUBLE)) / (max(pa)::DOUBLE * max(na)) AS auc,
        sum(pos::DOUBLE / pa * tp / (tp + fp)) AS average_precision FROM pts GROUP BY cohort)
    SELECT p.cohort, cut, sensitivity, specificity, auc, average_precision FROM p JOIN point USING (cohort)""")
def operating_point_summary(spark, d):
    counts = counts_of(spark, d)
    return curves.operating_point(counts, ["cohort"]).join(curves.auc(counts, ["cohort"]), "cohort").join(curves.average_precision(counts, ["cohort"]), "cohort")


@query(f"""WITH {COHORTS_SQL}, {CURVE}, {_APPLIED}, p AS (SELECT cohort, sum(pos * ((na - fp) + neg / 2.0::DOUBLE)) / (max(pa)::DOUBLE * max(na)) AS auc FROM pts GROUP BY cohort)
    SELECT cohort, n, tp::DOUBLE / (tp + fn) AS sensitivity, tn::DOUBLE / (tn + fp) AS specificity, auc FROM applied JOIN p USING (cohort)""")
def applied_point_summary(spark, d):
    at = curves.apply_cut(cohorts(spark, d), ill(), "baseline_raw", F.lit(1.25), ["cohort"]).select("cohort", "n", "sensitivity", "specificity")
    return at.join(curves.auc(counts_of(spark, d), ["cohort"]), "cohort")


# ---------------------------------------------------------------- comparisons of two models

_CLASS_SUMS = [f"true_{g}" for g in range(5)] + [f"{arm}_{kind}_{g}" for arm in "ab" for kind in ("said", "hit") for g in range(5)]


def _class_exprs() -> dict[str, str]:
    out = {f"true_{g}": f"diagnosis = {g}" for g in range(5)}
    for arm, c in (("a", "pred"), ("b", "cand")):
        out |= {f"{arm}_said_{g}": f"{c} = {g}" for g in range(5)} | {f"{arm}_hit_{g}": f"{c} = {g} AND diagnosis = {g}" for g in range(5)}
    return out


def _f1_sql(arm: str) -> str:
    return "(" + " + ".join(f"coalesce(2.0::DOUBLE * {arm}_hit_{g} / nullif(true_{g} + {arm}_said_{g}, 0), 0)" for g in range(5)) + ") / 5"


_MOMENTS = {
    "n": "1", "t": "diagnosis", "tt": "diagnosis * diagnosis", "a": "pred", "aa": "pred * pred", "ta": "diagnosis * pred",
    "b": "cand", "bb": "cand * cand", "tb": "diagnosis * cand",
}
_PAIRED_SUMS = f"""sums AS (SELECT patient_id, {", ".join(f"sum({e}) AS {k}" for k, e in _MOMENTS.items())},
    {", ".join(f"count(*) FILTER ({e}) AS {k}" for k, e in _class_exprs().items())} FROM preds GROUP BY patient_id), {DRAWN},
    s AS (SELECT draw, {", ".join(f"sum({k})::DOUBLE AS {k}" for k in [*_MOMENTS, *_CLASS_SUMS])} FROM dr JOIN cl USING (place) GROUP BY draw),
    long AS (SELECT 'qwk' AS metric, ({kappa_sql("b")}) - ({kappa_sql("a")}) AS value FROM s UNION ALL SELECT 'macro_f1', {_f1_sql("b")} - {_f1_sql("a")} FROM s)"""


def _paired_intervals(spark, d) -> DataFrame:
    sums = {k: F.sum(F.expr(e)) for k, e in _MOMENTS.items()} | {k: F.count_if(F.expr(e)) for k, e in _class_exprs().items()}
    s = resampled_sums(spark, d, sums)
    c = lambda x: F.col(x).cast("double")
    kappa = lambda p: 1 - F.try_divide(c("tt") + c(p + p) - 2 * c("t" + p), c("tt") + c(p + p) - 2 * c("t") * c(p) / c("n"))
    one = lambda arm, g: F.coalesce(S.ratio(2 * F.col(f"{arm}_hit_{g}"), F.col(f"true_{g}") + F.col(f"{arm}_said_{g}")), F.lit(0.0))
    f1 = lambda arm: sum((one(arm, g) for g in range(5)), F.lit(0.0)) / 5
    return resample.interval(s.select("draw", (kappa("b") - kappa("a")).alias("qwk"), (f1("b") - f1("a")).alias("macro_f1")), ["qwk", "macro_f1"], DRAWS)


@query(f"WITH {PREDS_SQL}, {_PAIRED_SUMS} {LIMITS}")
def bootstrap_grades_ci(spark, d):
    return _paired_intervals(spark, d)


def _arm_sql(arm: str, c: str) -> str:
    cells = f"(SELECT diagnosis AS t, {c} AS p, count(*)::DOUBLE AS n FROM preds GROUP BY ALL)"
    return f"""{arm} AS (SELECT unnest(['qwk', 'macro_f1', 'accuracy', 'sensitivity', 'specificity']) AS metric, unnest([qwk, macro_f1, accuracy, se, sp]) AS value FROM (
        SELECT 1 - sum(n * (t - p) ** 2) / (sum(n * t * t) + sum(n * p * p) - 2 * sum(n * t) * sum(n * p) / sum(n)) AS qwk, {GRADE},
            sum(n) FILTER (t >= 2 AND p >= 2) / sum(n) FILTER (t >= 2) AS se, sum(n) FILTER (t < 2 AND p < 2) / sum(n) FILTER (t < 2) AS sp FROM {cells}))"""


@query(f"""WITH {PREDS_SQL}, {_arm_sql("base", "pred")}, {_arm_sql("next", "cand")}, {_PAIRED_SUMS}, limits AS ({LIMITS})
    SELECT metric, base.value AS baseline, next.value AS candidate, next.value - base.value AS difference, low, high
    FROM base JOIN next USING (metric) LEFT JOIN limits USING (metric)""")
def paired_report(spark, d):
    # The rows are read once for both arms: at most 125 cells.
    both = metrics.cells(graded(preds(spark, d)), "diagnosis", "pred", ["cand"])
    names = ["qwk", "macro_f1", "accuracy", "sensitivity", "specificity"]

    def arm(c: str, name: str) -> DataFrame:
        counted = both.groupBy("t", F.col(c).alias("p")).agg(F.sum("n").alias("n"))
        # One row beside one row.
        whole = metrics.qwk(counted, observed=True).crossJoin(metrics.grade_metrics(counted)).crossJoin(metrics.referable_confusion(counted))
        return audits.long(whole, [], names).withColumnRenamed("value", name)

    arms = arm("p", "baseline").join(arm("cand", "candidate"), "metric")
    limits = _paired_intervals(spark, d).select("metric", "low", "high")
    return arms.withColumn("difference", F.col("candidate") - F.col("baseline")).join(limits, "metric", "left")


_LONG_ARMS = """arms AS (SELECT diagnosis, unnest(['baseline', 'candidate', 'control']) AS arm, unnest([baseline_raw, candidate_raw, control_raw]) AS raw FROM preds),
    graded AS (SELECT *, CAST((raw >= 0.5)::INTEGER + (raw >= 1.5)::INTEGER + (raw >= 2.5)::INTEGER + (raw >= 3.5)::INTEGER AS INTEGER) AS pred FROM arms)"""
_BLOCK_SQL = f"""{_LONG_ARMS}, {METRICS.format(by="arm,", src="graded")}, m AS (SELECT arm, {GRADE} FROM c GROUP BY arm),
    q AS (SELECT arm, 1 - sum(n * (t - p) ** 2) / (sum(n * t * t) + sum(n * p * p) - 2 * sum(n * t) * sum(n * p) / sum(n)) AS qwk FROM c GROUP BY arm),
    r AS ({REFERABLE.format(by="arm,", src="graded")}), k AS (SELECT arm, raw, count(*) FILTER (diagnosis >= 2) AS pos, count(*) FILTER (diagnosis < 2) AS neg FROM arms GROUP BY ALL),
    u AS (SELECT arm, pos, neg, coalesce(sum(neg) OVER (PARTITION BY arm ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
    a AS (SELECT arm, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM u GROUP BY arm),
    block AS (SELECT * FROM m JOIN q USING (arm) JOIN r USING (arm) JOIN a USING (arm))"""


def _blocks(spark, d) -> DataFrame:
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}_raw").alias("raw")) for a in ("baseline", "candidate", "control")])).alias("x")
    rows = preds(spark, d).select("diagnosis", arms).select("diagnosis", "x.arm", "x.raw").withColumn("pred", S.digitize(F.col("raw")))
    return metrics.metric_block(rows, "diagnosis", "raw", "pred", ["arm"])


@query(f"WITH {PREDS_SQL}, {_BLOCK_SQL} SELECT * FROM block")
def metric_block(spark, d):
    return _blocks(spark, d)


@query(f"""WITH {PREDS_SQL}, {_BLOCK_SQL}, v AS (SELECT arm, unnest(['auc', 'qwk', 'macro_f1']) AS metric, unnest([auc, qwk, macro_f1]) AS value FROM block)
    SELECT arm, metric, value + CASE WHEN arm = 'control' AND metric = 'qwk' THEN 0.001 ELSE 0 END AS recorded, value AS found,
        NOT (arm = 'control' AND metric = 'qwk') AS matches FROM v""")
def followup_audit(spark, d):
    found = audits.long(_blocks(spark, d), ["arm"], ["auc", "qwk", "macro_f1"])
    tampered = F.when((F.col("arm") == "control") & (F.col("metric") == "qwk"), 0.001).otherwise(0.0)
    return audits.same(found.withColumn("value", F.col("value") + tampered), found, ["arm", "metric"])


# ---------------------------------------------------------------- sweeps

_SWEEP = """f AS (SELECT id_code, diagnosis, f AS fold, diagnosis + (CAST('0x' || substr(md5('f' || f || ':' || id_code), 1, 8) AS BIGINT) % 1000 / 1000.0::DOUBLE - 0.5) * 2 AS raw
        FROM eyes, (SELECT unnest(range(1, 6)) AS f)),
    cuts AS (SELECT f AS fold, g AS k, g - 0.5::DOUBLE + (f - 3) / 50.0::DOUBLE AS c FROM (SELECT unnest(range(1, 6)) AS f), (SELECT unnest(range(1, 5)) AS g)),
    every AS (SELECT fold, list(c ORDER BY k) AS cuts FROM cuts GROUP BY fold UNION ALL SELECT 0, list(c ORDER BY k) FROM (SELECT k, avg(c) AS c FROM cuts GROUP BY k)),
    scored AS (SELECT fold, diagnosis, raw FROM f UNION ALL SELECT 0, diagnosis, avg(raw) FROM f GROUP BY id_code, diagnosis),
    graded AS (SELECT fold, diagnosis, CAST(len(list_filter(cuts, lambda x: x <= raw)) AS INTEGER) AS pred FROM scored JOIN every USING (fold))"""
_SWEEP_METRICS = f"""{_SWEEP}, {METRICS.format(by="fold,", src="graded")}, m AS (SELECT fold, {GRADE} FROM c GROUP BY fold),
    q AS (SELECT fold, 1 - sum(n * (t - p) ** 2) / (sum(n * t * t) + sum(n * p * p) - 2 * sum(n * t) * sum(n * p) / sum(n)) AS qwk FROM c GROUP BY fold),
    r AS ({REFERABLE.format(by="fold,", src="graded")}),
    s AS (SELECT fold, coalesce(CAST(sum(n) FILTER (t >= 3 AND p <= 1) AS BIGINT), 0) AS severe_missed FROM c GROUP BY fold),
    sweep AS (SELECT CAST(fold AS INTEGER) AS fold, n, accuracy, macro_f1, qwk, sensitivity, specificity, severe_missed
        FROM m JOIN q USING (fold) JOIN r USING (fold) JOIN s USING (fold))"""


def _fold_scores(spark, d) -> DataFrame:
    rows = eyes(spark, d).select("id_code", "diagnosis", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold"))
    h = S.hash32(F.concat(F.lit("f"), F.col("fold").cast("string"), F.lit(":"), F.col("id_code").cast("string")))
    return rows.withColumn("raw", F.col("diagnosis") + ((h % 1000) / F.lit(1000.0) - 0.5) * 2)


def _sweep(spark, d) -> DataFrame:
    cuts = spark.createDataFrame([(f, [g - 0.5 + (f - 3) / 50 for g in range(1, 5)]) for f in range(1, 6)], "fold int, cuts array<double>")
    return audits.sweep_metrics(_fold_scores(spark, d), cuts, "id_code", "diagnosis")


@query(f"WITH {EYES_SQL}, {_SWEEP_METRICS} SELECT * FROM sweep")
def sweep_recomputed(spark, d):
    return _sweep(spark, d)


@query(f"""WITH {EYES_SQL}, {_SWEEP_METRICS}, v AS (SELECT fold, unnest(['qwk', 'accuracy', 'macro_f1', 'sensitivity', 'specificity', 'severe_missed']) AS metric,
        unnest([qwk, accuracy, macro_f1, sensitivity, specificity, severe_missed::DOUBLE]) AS value FROM sweep)
    SELECT fold, metric, value + CASE WHEN fold = 2 AND metric = 'accuracy' THEN 0.0001 ELSE 0 END AS recorded, value AS found,
        NOT (fold = 2 AND metric = 'accuracy') AS matches FROM v""")
def sweep_recomputed_audit(spark, d):
    found = audits.long(_sweep(spark, d), ["fold"], ["qwk", "accuracy", "macro_f1", "sensitivity", "specificity", "severe_missed"])
    tampered = F.when((F.col("fold") == 2) & (F.col("metric") == "accuracy"), 0.0001).otherwise(0.0)
    return audits.same(found.withColumn("value", F.col("value") + tampered), found, ["fold", "metric"])


@query(f"""WITH {EYES_SQL}, {_SWEEP_METRICS}, v AS (SELECT fold, unnest(['qwk', 'accuracy', 'macro_f1', 'sensitivity']) AS metric,
        unnest([qwk, accuracy, macro_f1, sensitivity]) AS value FROM sweep)
    SELECT metric, count(*) FILTER (fold > 0) AS folds, avg(value) FILTER (fold > 0) AS mean, stddev_samp(value) FILTER (fold > 0) AS std,
        max(value) FILTER (fold = 0) AS ensemble, max(value) FILTER (fold = 0) - avg(value) FILTER (fold > 0) AS gain FROM v GROUP BY metric""")
def sweep_summary(spark, d):
    rows = audits.long(_sweep(spark, d), ["fold"], ["qwk", "accuracy", "macro_f1", "sensitivity"])
    return audits.summary_with_ensemble(rows)


@query(f"WITH {EYES_SQL}, {_SWEEP} SELECT id_code, stddev_samp(raw) AS spread FROM f GROUP BY id_code")
def fold_spread(spark, d):
    return _fold_scores(spark, d).groupBy("id_code").agg(F.stddev_samp("raw").alias("spread"))


@query(f"""WITH {EYES_SQL}, {_SWEEP} SELECT CAST(e.fold AS BIGINT) AS fold, count(*) AS n, avg(raw) AS mean_raw FROM eyes e JOIN f ON f.id_code = e.id_code AND f.fold = e.fold GROUP BY e.fold""")
def out_of_fold(spark, d):
    assigned = eyes(spark, d).select("id_code", F.col("fold").cast("int").alias("fold"))
    found = splits.out_of_fold(assigned, _fold_scores(spark, d).select("id_code", "fold", "raw"), "id_code", "fold")
    return found.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("mean_raw"))


@query("""WITH per AS (SELECT user_id, event_id % 5 + 1 AS fold, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, count(*) AS folds, CAST(sum(n) AS BIGINT) AS "rows", 5 - count(*) AS missing, count(*) = 5 AND min(n) = max(n) AS complete FROM per GROUP BY user_id""")
def fold_completeness(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 5 + 1).cast("int").alias("fold"))
    return audits.fold_completeness(rows, ["user_id"], 5)


# ---------------------------------------------------------------- tests with p-values

_RANKS = """per AS (SELECT {v} AS value, {g} AS grp, count(*) AS n FROM {src} GROUP BY ALL), ties AS (SELECT value, sum(n) AS ties FROM per GROUP BY value),
    ranks AS (SELECT value, ties, coalesce(sum(ties) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (ties + 1) / 2.0::DOUBLE AS rank FROM ties)"""


@query(f"""WITH {_RANKS.format(v="p_retailprice", g="p_size % 5", src="part")}, g AS (SELECT grp, sum(n) AS n, sum(rank * n) AS r FROM per JOIN ranks USING (value) GROUP BY grp),
    t AS (SELECT sum(ties::DOUBLE ** 3 - ties) AS t FROM ranks), s AS (SELECT sum(n)::DOUBLE AS n, sum(r * r / n) AS q, count(*) AS groups FROM g),
    k AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, groups FROM s, t)
    SELECT h, groups, exp(-h / 2) * (1 + h / 2) AS p_value FROM k""")
def kruskal_p(spark, d):
    rows = table(spark, d, "part").withColumn("g", (F.col("p_size") % 5).cast("long"))
    return stats.with_p(stats.kruskal(rows, "p_retailprice", "g"), "p_value", lambda h, groups: stats.chi2_sf(h, int(groups) - 1), "h", "groups")


@query(f"""WITH {_RANKS.format(v="p_retailprice", g="p_size % 5 = 0", src="part")}, s AS (SELECT sum(rank * n) FILTER (grp) AS r, sum(n) FILTER (grp)::DOUBLE AS n1,
        sum(n) FILTER (NOT grp)::DOUBLE AS n2 FROM per JOIN ranks USING (value)),
    t AS (SELECT sum(ties::DOUBLE ** 3 - ties) AS t FROM ranks), u AS (SELECT r - n1 * (n1 + 1) / 2 AS u, n1, n2, t, n1 + n2 AS n FROM s, t),
    z AS (SELECT u, (abs(u - n1 * n2 / 2) - 0.5::DOUBLE) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))) AS z FROM u),
    area AS (SELECT u, sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 2000, 2) / 2)) * z / 6000 / sqrt(2 * pi()) AS a
        FROM z, (SELECT unnest(range(2001)) AS i) GROUP BY u, z) SELECT u, 1 - 2 * a AS p_value FROM area""")
def mann_whitney_p(spark, d):
    rows = table(spark, d, "part").withColumn("g", F.when(F.col("p_size") % 5 == 0, "a").otherwise("b"))
    tested = stats.mann_whitney(rows, "p_retailprice", "g", "a")
    return stats.with_p(tested, "p_value", lambda u, n1, n2, z, s, tied: stats.mann_whitney_p(u, int(n1), int(n2), z, s, bool(tied)), "u", "n1", "n2", "z", "spread", "tied").select("u", "p_value")


@query(f"""WITH {RUNS_SQL}, x AS (SELECT a.variant, count(*) AS n, avg(b.metric - a.metric) * sqrt(count(*)) / nullif(stddev_samp(b.metric - a.metric), 0) AS t
    FROM runs a JOIN runs b ON a.fold = b.fold AND b.variant = (SELECT min(variant) FROM runs) AND a.variant <> b.variant GROUP BY a.variant)
    SELECT variant, n, t, 1 - 0.75::DOUBLE * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4))) AS p_value FROM x""")
def paired_t_p(spark, d):
    rows = runs(spark, d)
    least = Window.partitionBy("fold").orderBy("variant")
    ranked = rows.withColumns({"base": F.first("metric").over(least), "base_variant": F.first("variant").over(least)})
    tested = stats.paired_t(ranked.where("variant <> base_variant"), "metric", "base", ["variant"]).select("variant", "n", "t")
    return stats.with_p(tested, "p_value", lambda n, t: stats.t_sf2(t, int(n) - 1), "n", "t")


# ---------------------------------------------------------------- label noise, classes, sites, groups


@query(f"""WITH {EYES_SQL}, r AS (SELECT patient_id || ':' || stratum AS g, id_code AS k, diagnosis AS v FROM eyes)
    SELECT abs(a.v - b.v) AS gap, count(*) AS pairs FROM r a JOIN r b ON a.g = b.g AND a.k < b.k AND a.v <> b.v GROUP BY gap""")
def label_noise_gaps(spark, d):
    return quality.gap_counts(eyes(spark, d).withColumn("g", F.concat_ws(":", F.col("patient_id").cast("string"), "stratum")), "g", "diagnosis")


_PICTURES = """pictures AS (SELECT p_partkey AS id_code, CAST(p_size % 5 AS INTEGER) AS diagnosis, CAST(p_size * 30 + 500 AS INTEGER) AS width,
    CAST(p_size * 30 + 500 + (p_partkey % 9 - 4) * 8 AS INTEGER) AS height, p_retailprice AS brightness, CAST(p_partkey * 37 + 1000 AS BIGINT) AS size_bytes FROM part)"""


def _pictures(spark, d) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        k.alias("id_code"), (s % 5).cast("int").alias("diagnosis"), (s * 30 + 500).cast("int").alias("width"), (s * 30 + 500 + (k % 9 - 4) * 8).cast("int").alias("height"),
        F.col("p_retailprice").alias("brightness"), (k * 37 + 1000).cast("long").alias("size_bytes"),
    )


@query(f"""WITH {_PICTURES} SELECT diagnosis, count(*) AS n, avg(CAST(a > 0.98 AND a < 1.02 AS INTEGER)) AS near_square_share, median(brightness) AS median_brightness,
    median(a) AS median_aspect FROM (SELECT *, width::DOUBLE / height AS a FROM pictures) GROUP BY diagnosis""")
def class_medians(spark, d):
    rows = _pictures(spark, d).withColumn("aspect", F.col("width") / F.col("height"))
    return quality.class_medians(rows, "diagnosis", ["brightness", "aspect"], "aspect")


@query(f"""WITH {_PICTURES} SELECT id_code, round(width::DOUBLE * height / 1e6, 6) AS pixels, CASE WHEN width = 1050 AND height = 1050 THEN '1050x1050' ELSE 'other' END AS bucket,
    1 - (width - 20) * (height - 30)::DOUBLE / (width * height) AS crop_saving FROM pictures""")
def image_geometry(spark, d):
    rows = _pictures(spark, d)
    w, h = F.col("width"), F.col("height")
    saving = S.crop_saving(w, h, w - 20, h - 30)
    return rows.select("id_code", F.round(w.cast("double") * h / 1e6, 6).alias("pixels"), S.resolution_bucket(w, h).alias("bucket"), saving.alias("crop_saving"))


@query(f"WITH {_PICTURES} SELECT count(DISTINCT (width, height)) AS resolutions FROM pictures")
def distinct_resolutions(spark, d):
    return _pictures(spark, d).select("width", "height").distinct().agg(F.count(F.lit(1)).alias("resolutions"))


@query(f"""WITH {COHORTS_SQL}, k AS (SELECT cohort, baseline_raw AS score, count(*) FILTER (diagnosis >= 2) AS pos, count(*) FILTER (diagnosis < 2) AS neg FROM cohorts GROUP BY ALL),
    u AS (SELECT cohort, pos, neg, coalesce(sum(neg) OVER (PARTITION BY cohort ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
    a AS (SELECT cohort, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM u GROUP BY cohort),
    {METRICS.format(by="cohort,", src="cohorts")}, m AS (SELECT cohort, {GRADE} FROM c GROUP BY cohort),
    q AS (SELECT cohort, 1 - sum(n * (t - p) ** 2) / (sum(n * t * t) + sum(n * p * p) - 2 * sum(n * t) * sum(n * p) / sum(n)) AS qwk FROM c GROUP BY cohort),
    x AS (SELECT cohort, count(*) FILTER (diagnosis = 2) AS moderate, avg(CAST(pred < 2 AS INTEGER)) FILTER (diagnosis = 2) AS moderate_below_2,
        median(baseline_raw) FILTER (diagnosis = 2 AND patient_id % 2 = 0) AS median_without, median(baseline_raw) FILTER (diagnosis = 2 AND patient_id % 2 = 1) AS median_with
        FROM cohorts GROUP BY cohort)
    SELECT cohort, n, accuracy, macro_f1, auc, qwk, moderate, moderate_below_2, median_without, median_with FROM m JOIN a USING (cohort) JOIN q USING (cohort) JOIN x USING (cohort)""")
def site_summary(spark, d):
    rows = graded(cohorts(spark, d)).withColumn("flag", F.col("patient_id") % 2 == 1)
    return metrics.site_summary(rows, "diagnosis", "pred", "baseline_raw", "flag", "cohort")


@query(f"""WITH {COHORTS_SQL} SELECT cohort, {", ".join(f"count(*) FILTER ({c} = {g}) AS {name}_{g}" for c, name in (("diagnosis", "true"), ("pred", "pred")) for g in range(5))},
    count(*) FILTER (diagnosis = 0) AS healthy, count(*) FILTER (diagnosis = 0 AND pred >= 2) AS healthy_referred FROM cohorts GROUP BY cohort""")
def external_distributions(spark, d):
    return metrics.grade_counts(metrics.cells(graded(cohorts(spark, d)), "diagnosis", "pred", ["cohort"]), ["cohort"])


def _wilson_sql(k: str, n: str, sign: str) -> str:
    return f"(({k})::DOUBLE / ({n}) + 3.8416::DOUBLE / ({n}) / 2 {sign} 1.96::DOUBLE * sqrt(({k})::DOUBLE / ({n}) * (1 - ({k})::DOUBLE / ({n})) / ({n}) + 3.8416::DOUBLE / ({n}) / (4 * ({n})))) / (1 + 3.8416::DOUBLE / ({n}))"


@query(f"""WITH {COHORTS_SQL}, r AS (SELECT cohort, count(*) AS n, count(*) FILTER (diagnosis >= 2) AS ill, count(*) FILTER (diagnosis >= 2 AND pred < 2) AS missed,
        count(*) FILTER (diagnosis < 2 AND pred < 2) AS tn, count(*) FILTER (diagnosis >= 3) AS severe_total, count(*) FILTER (diagnosis >= 3 AND pred <= 1) AS severe_missed
        FROM cohorts GROUP BY cohort)
    SELECT cohort, n, ill AS referable, missed, (ill - missed)::DOUBLE / ill AS sensitivity, tn::DOUBLE / (n - ill) AS specificity,
        {_wilson_sql("ill - missed", "ill", "-")} AS sensitivity_low, {_wilson_sql("ill - missed", "ill", "+")} AS sensitivity_high,
        {_wilson_sql("tn", "n - ill", "-")} AS specificity_low, {_wilson_sql("tn", "n - ill", "+")} AS specificity_high, severe_total, severe_missed FROM r""")
def cohort_summary(spark, d):
    return metrics.cohort_summary(metrics.cells(graded(cohorts(spark, d)), "diagnosis", "pred", ["cohort"]), ["cohort"])


@query("""WITH RECURSIVE v AS (SELECT label, min(vec_id) AS vec_id, embedding FROM embeddings GROUP BY label, embedding),
    e AS (SELECT a.label, a.vec_id AS k, b.vec_id AS h, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM v a JOIN v b ON a.label = b.label AND b.vec_id < a.vec_id),
    near AS (SELECT label, k, list(h) AS hs FROM (SELECT label, k, h FROM e GROUP BY ALL HAVING corr(x, y) >= 0.1 AND avg(abs(x - y)) <= 0.3) GROUP BY ALL),
    r AS (SELECT v.label, v.vec_id, coalesce(hs, []) AS hs, row_number() OVER (PARTITION BY v.label ORDER BY v.vec_id) AS i FROM v LEFT JOIN near ON near.label = v.label AND k = v.vec_id),
    walk AS (SELECT label, vec_id, vec_id AS head, i, [vec_id] AS heads FROM r WHERE i = 1
        UNION ALL SELECT r.label, r.vec_id, coalesce(list_min(list_intersect(heads, r.hs)), r.vec_id), r.i,
            CASE WHEN len(list_intersect(heads, r.hs)) = 0 THEN list_append(heads, r.vec_id) ELSE heads END FROM walk JOIN r ON r.label = walk.label AND r.i = walk.i + 1)
    SELECT m.label, m.vec_id, head FROM embeddings m JOIN v ON v.label = m.label AND v.embedding = m.embedding JOIN walk ON walk.label = v.label AND walk.vec_id = v.vec_id""")
def leader_groups(spark, d):
    return quality.leader_groups(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.1, 0.3)


# ---------------------------------------------------------------- filters and projections


@query(f"WITH {EYES_SQL} SELECT split, CASE WHEN split = 'test' THEN 'holdout' ELSE 'pool' END AS part, count(*) AS n FROM eyes GROUP BY ALL")
def pool_and_holdout(spark, d):
    return splits.pool_and_holdout(eyes(spark, d), "split").groupBy("split", "part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> '' AND text <> 'NaN' GROUP BY source")
def readable_rows(spark, d):
    return quality.readable(table(spark, d, "documents"), "text").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS_SQL} SELECT split, count(*) AS n FROM docs WHERE diagnosis IS NOT NULL AND brightness IS NOT NULL GROUP BY split")
def complete_features(spark, d):
    return docs(spark, d).dropna(subset=["diagnosis", "brightness"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_WIDE = "diagnosis + (CAST('0x' || substr(md5('w' || id_code), 1, 8) AS BIGINT) % 1000 / 1000.0::DOUBLE - 0.5) * 5"


@query(f"""WITH {EYES_SQL}, w AS (SELECT id_code, diagnosis, {_WIDE} AS raw FROM eyes), p AS (SELECT *, {DIGIT_SQL.format("raw")} AS pred FROM w)
    SELECT id_code, diagnosis, pred FROM p WHERE diagnosis >= 3 AND pred <= 1""")
def missed_severe(spark, d):
    rows = eyes(spark, d).withColumn("pred", S.digitize(noisy("w", 5.0)))
    return metrics.missed_severe(rows, "diagnosis", "pred").select("id_code", "diagnosis", "pred")


@query(f"WITH {EYES_SQL} SELECT id_code FROM eyes ORDER BY CAST('0x' || substr(md5('42:' || id_code), 1, 8) AS BIGINT), id_code LIMIT 50")
def smoke_sample(spark, d):
    return splits.smoke_sample(eyes(spark, d), "id_code", 50).select("id_code")


_PARTS = "CASE fold WHEN 1 THEN 'test' WHEN 2 THEN 'tune-valid' ELSE 'tune-train' END"


def _parted(spark, d) -> DataFrame:
    return preds(spark, d).withColumn("part", F.when(F.col("fold") == 1, "test").when(F.col("fold") == 2, "tune-valid").otherwise("tune-train"))


@query(f"""WITH {PREDS_SQL}, p AS (SELECT *, {_PARTS} AS part FROM preds)
    SELECT arm, part, CAST(CASE WHEN arm = 'control' AND part = 'tune-train' THEN pred ELSE diagnosis END AS INTEGER) AS diagnosis, count(*) AS n
    FROM p, (SELECT unnest(['adjudicated', 'control']) AS arm) WHERE part <> 'test' GROUP BY ALL""")
def training_arms(spark, d):
    return splits.training_arms(graded(_parted(spark, d)), "part", "diagnosis", "pred").groupBy("arm", "part", "diagnosis").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- splits


@query(f"""WITH {EYES_SQL}, g AS (SELECT patient_id, max(diagnosis) AS top, count(*) AS size FROM eyes GROUP BY ALL),
    h AS (SELECT *, CAST('0x' || substr(md5('42:' || patient_id), 1, 8) AS BIGINT) AS o FROM g),
    a AS (SELECT *, (row_number() OVER (PARTITION BY top, size ORDER BY o, patient_id) - 1) % 2 + 1 AS half FROM h),
    b AS (SELECT *, (row_number() OVER (PARTITION BY top, size ORDER BY o, patient_id) - 1) % 5 + 1 AS fold FROM a WHERE half = 2),
    p AS (SELECT patient_id, 'test' AS part FROM a WHERE half = 1 UNION ALL SELECT patient_id, CASE WHEN fold = 1 THEN 'tune-valid' ELSE 'tune-train' END FROM b)
    SELECT part, count(*) AS eyes, count(DISTINCT patient_id) AS groups, count(*) FILTER (diagnosis >= 2) AS referable FROM eyes JOIN p USING (patient_id) GROUP BY part""")
def nested_split(spark, d):
    rows = splits.nested_split(eyes(spark, d).drop("fold"), "patient_id", "diagnosis")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("eyes"), F.count_distinct("patient_id").alias("groups"), F.count_if(ill()).alias("referable"))


@query(f"""WITH {EYES_SQL}, p AS (SELECT *, CASE WHEN stratum = 'P' AND fold = 5 THEN 'spare' ELSE {_PARTS} END AS part, id_code // 2 AS exam FROM eyes),
    was AS (SELECT id_code, CASE WHEN stratum = 'P' THEN (diagnosis + 1) % 5 ELSE diagnosis END AS diagnosis FROM eyes WHERE NOT (stratum = 'P' AND fold = 3)),
    x AS (SELECT exam, count(DISTINCT part) AS parts FROM p GROUP BY exam), j AS (SELECT p.id_code AS a, was.id_code AS b, p.diagnosis AS x, was.diagnosis AS y FROM p FULL JOIN was ON p.id_code = was.id_code)
    SELECT (SELECT count(*) FILTER (a IS NULL OR b IS NULL) = 0 FROM j) AS same_ids, (SELECT count(*) FILTER (x IS DISTINCT FROM y) = 0 FROM j) AS same_grades,
        (SELECT count(*) FILTER (part NOT IN ('tune-train', 'tune-valid', 'test')) = 0 FROM p) AS known_parts, (SELECT count(*) FILTER (ill = 0 OR ill = n) = 0 FROM (
        SELECT part, count(*) FILTER (diagnosis >= 2) AS ill, count(*) AS n FROM p GROUP BY part)) AS both_classes, (SELECT count(*) FILTER (parts > 1) = 0 FROM x) AS disjoint""")
def exam_split_check(spark, d):
    """A split against an earlier label table that lacks some eyes and grades others differently; some eyes are in an unknown part."""
    odd = F.col("stratum") == "P"
    rows = _parted(spark, d).withColumn("exam", F.floor(F.col("id_code") / 2)).withColumn("part", F.when(odd & (F.col("fold") == 5), "spare").otherwise(F.col("part")))
    was = eyes(spark, d).where(~(odd & (F.col("fold") == 3))).withColumn("diagnosis", F.when(odd, (F.col("diagnosis") + 1) % 5).otherwise(F.col("diagnosis")))
    return splits.split_check(rows, was, "id_code", "diagnosis", "exam", "part")


@query(f"""WITH {EYES_SQL}, p AS (SELECT {_PARTS} AS old_part, CASE diagnosis % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'tune-valid' ELSE 'tune-train' END AS new_part FROM eyes)
    SELECT old_part, new_part, count(*) AS n, new_part = 'test' AND old_part <> 'test' AS exposed FROM p GROUP BY ALL""")
def split_exposures(spark, d):
    old = _parted(spark, d).select("id_code", "part")
    third = F.col("diagnosis") % 3
    new = eyes(spark, d).select("id_code", F.when(third == 0, "test").when(third == 1, "tune-valid").otherwise("tune-train").alias("part"))
    return splits.exposures(old, new, "id_code", "part")


@query(f"""WITH {EYES_SQL} SELECT diagnosis, stratum, count(*) AS n FROM eyes GROUP BY ALL HAVING n < 400""")
def small_strata(spark, d):
    return splits.small_strata(eyes(spark, d), ["diagnosis", "stratum"], 400)


@query(f"""WITH {EYES_SQL}, f AS (SELECT *, (row_number() OVER (PARTITION BY diagnosis, stratum ORDER BY CAST('0x' || substr(md5('42:' || id_code), 1, 8) AS BIGINT), id_code) - 1) % 5 + 1 AS k FROM eyes)
    SELECT CAST(k AS INTEGER) AS fold, diagnosis, stratum, count(*) AS n FROM f GROUP BY ALL""")
def joint_strata_folds(spark, d):
    dealt = splits.stratified_folds(eyes(spark, d).drop("fold"), "id_code", ["diagnosis", "stratum"], 5)
    return dealt.groupBy("fold", "diagnosis", "stratum").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- joins and contracts


@query(f"""WITH {EYES_SQL}, a AS (SELECT id_code, diagnosis, row_number() OVER (ORDER BY id_code) AS pos FROM eyes WHERE NOT (stratum = 'P' AND fold = 3)),
    b AS (SELECT id_code, CASE WHEN stratum = 'P' THEN 4 - diagnosis ELSE diagnosis END AS diagnosis,
        row_number() OVER (ORDER BY diagnosis, CAST('0x' || substr(md5(CAST(id_code AS VARCHAR)), 1, 8) AS BIGINT), id_code) AS pos FROM eyes WHERE NOT (stratum = 'P' AND fold = 4)),
    j AS (SELECT a.id_code AS l, b.id_code AS r, a.pos AS p, b.pos AS q, a.diagnosis AS x, b.diagnosis AS y FROM a FULL JOIN b ON a.id_code = b.id_code),
    n AS (SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS matched, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right,
        count(*) FILTER (p <> q) AS moved, count(*) FILTER (x <> y) AS diagnosis_differs FROM j)
    SELECT *, only_left + only_right + moved + diagnosis_differs = 0 AS aligned FROM n""")
def aligned_folds(spark, d):
    """Two orders of eyes that each lack some; the second goes by grade, then by a hash, so that ranges cut through equal grades, and grades some otherwise."""
    odd, rows = F.col("stratum") == "P", eyes(spark, d)
    spread = F.col("diagnosis") + S.hash32(F.col("id_code").cast("string")) / F.lit(float(1 << 32))
    a = numbered(rows.where(~(odd & (F.col("fold") == 3))), F.col("id_code"), ["id_code"])
    b = numbered(rows.where(~(odd & (F.col("fold") == 4))), spread, ["id_code"]).withColumn("diagnosis", F.when(odd, 4 - F.col("diagnosis")).otherwise(F.col("diagnosis")))
    a, b = (x.select("id_code", "diagnosis", F.col("_place").alias("pos")) for x in (a, b))
    return joins.aligned(a, b, "id_code", "pos", ["diagnosis"])


@query("""SELECT p_partkey AS id_code, 'scans/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.JPG' ELSE '.png' END AS image_id FROM part""")
def stem_alignment(spark, d):
    k = F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id_code"), F.concat(k, F.lit(".jpg")).alias("image_id"))
    files = table(spark, d, "part").select(F.concat(F.lit("scans/"), k, F.when(F.col("p_partkey") % 2 == 0, ".JPG").otherwise(".png")).alias("file"))
    return joins.align_stems(rows, files, "image_id", "file")


@query("""SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS n, count(x.c) AS known FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY ALL) x ON k = c_custkey GROUP BY ALL""")
def dictionary_lookups(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("n_nationkey"))
    named = joins.lookups(rows, "n_nationkey", {"n_name": table(spark, d, "nation")})
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return joins.lookups(named, "k", {"c": orders}).groupBy("segment", F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count("c").alias("known"))


_GRADE_TEXT = "CAST(l_linenumber - 1 AS VARCHAR) || CASE l_linestatus WHEN 'O' THEN '.00' ELSE '' END || CASE l_returnflag WHEN 'R' THEN 'x' ELSE '' END"


@query(f"SELECT regexp_full_match({_GRADE_TEXT}, '[0-4](\\.0+)?') AS valid, count(*) AS n FROM lineitem GROUP BY valid")
def strict_grades(spark, d):
    text = F.concat((F.col("l_linenumber") - 1).cast("string"), F.when(F.col("l_linestatus") == "O", ".00").otherwise(""), F.when(F.col("l_returnflag") == "R", "x").otherwise(""))
    return table(spark, d, "lineitem").select(text.alias("g")).groupBy(checks.is_whole_grade("g").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {COHORTS_SQL}, x AS (SELECT cohort, CASE WHEN stratum = 'P' AND cohort = 'ASIA' THEN NULL ELSE diagnosis >= 2 END AS y,
        CASE WHEN cohort = 'EUROPE' THEN baseline_raw ELSE greatest(least(baseline_raw / 6 + 0.25, 1), 0) END AS s FROM cohorts)
    SELECT cohort, count(*) AS n, count(*) FILTER (y IS NULL) AS bad_labels, count(*) FILTER (NOT (s BETWEEN 0 AND 1)) AS bad_scores,
        count(*) FILTER (y IS NULL) = 0 AND count(*) FILTER (NOT (s BETWEEN 0 AND 1)) = 0 AND count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0 AS usable
    FROM x GROUP BY cohort""")
def score_contracts(spark, d):
    rows = cohorts(spark, d)
    squeezed = F.greatest(F.least(F.col("baseline_raw") / 6 + 0.25, F.lit(1.0)), F.lit(0.0))
    rows = rows.withColumn("s", F.when(F.col("cohort") == "EUROPE", F.col("baseline_raw")).otherwise(squeezed))
    y = F.when((F.col("stratum") == "P") & (F.col("cohort") == "ASIA"), None).otherwise(ill())
    return checks.binary_scores(rows, y, "s", ["cohort"], probability=True)


_CUT_LIST = "list_transform(range(1 + 3 * CAST(n_nationkey % 4 > 0 AS INTEGER)), lambda k: k * (n_nationkey % 3) + 0.5::DOUBLE)"


@query(f"""SELECT n_nationkey, len(c) = 4 AND len(list_filter(range(1, len(c)), lambda i: c[i + 1] <= c[i])) = 0 AS valid FROM (SELECT n_nationkey, {_CUT_LIST} AS c FROM nation)""")
def cut_contracts(spark, d):
    k = F.col("n_nationkey")
    cuts = F.transform(F.sequence(F.lit(0), F.when(k % 4 > 0, 3).otherwise(0)), lambda i: i * (k % 3) + F.lit(0.5))
    return table(spark, d, "nation").select("n_nationkey", checks.valid_cuts(cuts).alias("valid"))


@query("""SELECT c_custkey AS patient_id, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    WHERE coalesce(n, 0) <> 1""")
def not_exactly_one(spark, d):
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"))
    return checks.not_exactly_one(files, table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id")), "patient_id")


@query("""WITH was AS (SELECT doc_id, sha256(text) AS h FROM documents), now AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS h
    FROM documents JOIN labels USING (doc_id))
    SELECT CASE WHEN now.doc_id IS NULL THEN 'missing' WHEN was.doc_id IS NULL THEN 'added' WHEN was.h IS NOT DISTINCT FROM now.h THEN 'same' ELSE 'changed' END AS state, count(*) AS n
    FROM was FULL JOIN now ON was.doc_id = now.doc_id GROUP BY state""")
def source_signatures(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    touched = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id", F.sha2(touched, 256).alias("h"))
    return audits.signature_check(rows.select("doc_id", F.sha2("text", 256).alias("h")), now, "doc_id", "h")


# ---------------------------------------------------------------- scalars


@query("""WITH heads AS (SELECT vec_id, label, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE] AS x FROM embeddings),
    each AS (SELECT *, unnest(range(4)) AS k FROM heads)
    SELECT vec_id, CAST(k AS INTEGER) AS k, list_sum(list_transform(x, lambda v: 1 / (1 + exp(-v)))) AS expected, CAST(CAST(label AS INTEGER) % 5 > k AS INTEGER) AS target,
        x[1] + coalesce(list_sum(list_transform(x[2:k + 1], lambda v: ln(1 + exp(v)))), 0) AS cut FROM each""")
def ordinal_heads(spark, d):
    """A row for each vector and head: expected grade, the head's target and its cut."""
    x = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", "label", x.alias("x"))
    heads = F.arrays_zip(S.cumulative_targets(F.col("label").cast("int") % 5).alias("target"), S.cutpoints(F.get("x", F.lit(0)), F.slice("x", 2, 3)).alias("cut"))
    each = rows.select("vec_id", S.expected_grade(F.col("x")).alias("expected"), F.posexplode(heads).alias("k", "head"))
    return each.select("vec_id", "k", "expected", "head.target", "head.cut")


@query(f"""WITH {COHORTS_SQL} SELECT cohort, stratum, coalesce(printf('%.6f', count(*) FILTER (diagnosis >= 2 AND pred >= 2)::DOUBLE / nullif(count(*) FILTER (diagnosis >= 2 AND stratum <> 'P'), 0)), 'N/A') AS shown
    FROM cohorts GROUP BY cohort, stratum""")
def formatted_metrics(spark, d):
    rows = graded(cohorts(spark, d))
    per = rows.groupBy("cohort", "stratum").agg(F.count_if(ill() & (F.col("pred") >= 2)).alias("k"), F.count_if(ill() & (F.col("stratum") != "P")).alias("n"))
    return per.select("cohort", "stratum", S.shown(S.ratio(F.col("k"), F.col("n")), 6).alias("shown"))


@query(f"""WITH {PREDS_SQL}, x AS (SELECT split, CASE WHEN id_code % 8 = 1 THEN NULL WHEN id_code % 8 = 2 THEN 'NaN'::DOUBLE WHEN id_code % 8 = 3 THEN 'Infinity'::DOUBLE ELSE baseline_raw END AS s FROM preds)
    SELECT split, count(*) FILTER (s IS NOT NULL AND isfinite(s)) AS finite, count(*) FILTER (s IS NOT NULL AND s BETWEEN 0 AND 1) AS probabilities FROM x GROUP BY split""")
def finite_scores(spark, d):
    k = F.col("id_code") % 8
    odd = F.when(k == 1, None).when(k == 2, float("nan")).when(k == 3, float("inf")).otherwise(F.col("baseline_raw"))
    rows = preds(spark, d).withColumn("s", odd)
    return rows.groupBy("split").agg(F.count_if(S.finite(F.col("s"))).alias("finite"), F.count_if(checks.is_probability("s")).alias("probabilities"))


_ATTENTION_SQL = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT vec_id, label, sum(v * v) AS heat, sum(v * v) FILTER (100 * v > 10) AS inside,
        count(*) FILTER (100 * v > 10)::DOUBLE / count(*) AS area FROM x GROUP BY vec_id, label),
    seen AS (SELECT vec_id, label, CASE WHEN heat > 0 AND area > 0 AND area < 1 THEN inside / heat END AS mass, area, CASE WHEN heat > 0 AND area > 0 AND area < 1 THEN inside / heat / area END AS ratio FROM s)"""


def _attention(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", "label", concentration(F.transform(v, lambda x: x * x), F.transform(v, lambda x: x * 100)).alias("c"))
    return rows.select("vec_id", "label", "c.mass", "c.area", "c.ratio")


@query(f"WITH {_ATTENTION_SQL} SELECT vec_id, mass, area, ratio FROM seen")
def attention_concentration(spark, d):
    return _attention(spark, d).drop("label")


@query(f"WITH {_ATTENTION_SQL} SELECT label, count(*) AS n, avg(mass) AS mass, avg(area) AS area, avg(ratio) AS ratio FROM seen GROUP BY label")
def attention_by_grade(spark, d):
    return concentration_by(_attention(spark, d), "label")


@query(f"""WITH {_ATTENTION_SQL}, per AS (SELECT label, vec_id % 5 AS draw, count(*) AS n, avg(ratio) AS m FROM seen WHERE ratio IS NOT NULL GROUP BY ALL)
    SELECT label, count(*) AS draws, CAST(sum(n) AS BIGINT) AS n, avg(m) AS mean, stddev_samp(m) AS sd, min(m) AS low, max(m) AS high FROM per GROUP BY label""")
def attention_draws(spark, d):
    """Five draws of each label, told apart by the rows' ids."""
    return draw_spread(_attention(spark, d).withColumn("draw", F.col("vec_id") % 5), "label", "draw", "ratio")


@query(f"""WITH {_PICTURES}, seen AS (SELECT id_code, diagnosis, min(id_code) OVER (PARTITION BY diagnosis) AS first, row_number() OVER (PARTITION BY diagnosis ORDER BY id_code) AS j
        FROM pictures), dealt AS (SELECT diagnosis, (row_number() OVER (ORDER BY first, id_code) - 1) % 5 + 1 AS fold FROM seen),
    sizes AS (SELECT diagnosis, fold, count(*) AS n FROM dealt GROUP BY ALL), runs AS (SELECT diagnosis, fold, sum(n) OVER (PARTITION BY diagnosis ORDER BY fold) AS upto, n FROM sizes)
    SELECT id_code, seen.diagnosis, CAST(fold AS INTEGER) AS fold FROM seen JOIN runs ON seen.diagnosis = runs.diagnosis AND j > upto - n AND j <= upto""")
def row_order_folds(spark, d):
    """Folds as unshuffled cross-validation makes them, in order of rows."""
    return splits.row_order_folds(_pictures(spark, d), "id_code", "diagnosis", 5).select("id_code", "diagnosis", "fold")


@query()
def metadata_strata(spark, d):
    """The shortcut forest's agreement by stratum and over ALL; folds are stratified, in order of rows."""
    rows = splits.row_order_folds(_pictures(spark, d), "id_code", "diagnosis", 5).withColumn("stratum", S.resolution_bucket(F.col("width"), F.col("height")))
    counted = metrics.with_all(stats.metadata_forest(rows, ["width", "height", "brightness"], "diagnosis", "fold", ["stratum"]), "stratum")
    return metrics.grade_metrics(counted, ["stratum"]).join(metrics.qwk(counted, ["stratum"], observed=True), "stratum")


@query()
def forest_importances(spark, d):
    return stats.feature_importances(_pictures(spark, d), ["width", "height", "brightness", "size_bytes"], "diagnosis")
