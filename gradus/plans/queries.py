"""Queries of the evaluation and audit operators over the driver's tables, each with an independent SQL oracle where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions import scalars as S
from gradus.operators import audits, curves, joins, metrics, quality, resample, splits, stats
from gradus.operators.ranges import quantiles
from gradus.plans import sqlapi
from gradus.plans.adapters import COHORTS_SQL, DOCS_SQL, EYES_SQL, LINES_SQL, PREDS_SQL, RUNS_SQL, cohorts, docs, eyes, lines, preds, runs, table
from gradus.plans.registry import ORACLES, QUERIES, query
from gradus.plans.shared import CURVE, DRAWN, DRAWS, GRADE, LIMITS, METRICS, POINT, REFERABLE, cells, clusters, counts_of, fit_sql, graded, ill, kappa_sql, resampled_sums

__all__ = ["ORACLES", "QUERIES"]


# ---------------------------------------------------------------- SQL templates

RETURN_FLAGS = ("A", "N", "R")


def _template(spark: SparkSession, d: str, name: str) -> DataFrame:
    lines(spark, d).createOrReplaceTempView("gradus_labels")
    return sqlapi.run(spark, name, "gradus_labels", RETURN_FLAGS)


@query(f"""WITH {LINES_SQL} SELECT count(*) AS label_rows, count(DISTINCT id_code) AS distinct_ids, count(*) FILTER (id_code IS NULL) AS missing_ids,
    count(*) FILTER (diagnosis NOT BETWEEN 0 AND 4) AS invalid_grades, count(*) FILTER (split NOT IN ('A', 'N', 'R')) AS invalid_splits,
    count(*) FILTER (is_referable <> (diagnosis >= 2)) AS invalid_referral_flags FROM lines""")
def label_integrity(spark, d):
    return _template(spark, d, "label_integrity")


@query(f"""WITH {LINES_SQL}, c AS (SELECT split, diagnosis, count(*) AS n FROM lines GROUP BY ALL)
    SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY split) AS split_share FROM c""")
def grade_distribution(spark, d):
    return _template(spark, d, "grade_distribution")


@query(f"""WITH {LINES_SQL} SELECT split, count(*) AS eyes, count(*) FILTER (is_referable) AS referable,
    CAST(count(*) FILTER (is_referable) AS DOUBLE) / count(*) AS referable_share FROM lines GROUP BY split""")
def referral_prevalence(spark, d):
    return _template(spark, d, "referral_prevalence")


@query(f"""WITH {LINES_SQL} SELECT id_code, count(DISTINCT split) AS split_count, count(*) AS occurrences FROM lines GROUP BY id_code HAVING split_count > 1""")
def repeated_id_across_splits(spark, d):
    return _template(spark, d, "repeated_id_across_splits")


@query(f"WITH {LINES_SQL} SELECT split, diagnosis, count(*) AS n FROM lines GROUP BY ALL")
def load_verification(spark, d):
    return _template(spark, d, "load_verification")


# ---------------------------------------------------------------- counts, cells and metrics


@query(f"""WITH {EYES_SQL}, c AS (SELECT split, {", ".join(f"count(*) FILTER (diagnosis = {g}) AS grade_{g}" for g in range(5))}, count(*) AS total FROM eyes GROUP BY split)
    SELECT *, round(CAST(greatest(grade_0, grade_1, grade_2, grade_3, grade_4) AS DOUBLE) / least(nullif(grade_0, 0), nullif(grade_1, 0), nullif(grade_2, 0),
    nullif(grade_3, 0), nullif(grade_4, 0)), 2) AS imbalance FROM c""")
def split_counts(spark, d):
    counts = [F.count_if(F.col("diagnosis") == g).alias(f"grade_{g}") for g in range(5)]
    per = eyes(spark, d).groupBy("split").agg(*counts, F.count(F.lit(1)).alias("total"))
    grades = F.array(*[F.col(f"grade_{g}") for g in range(5)])
    return per.withColumn("imbalance", F.round(F.array_max(grades) / F.array_min(F.filter(grades, lambda n: n > 0)), 2))


@query(f"""WITH {PREDS_SQL}, g AS (SELECT unnest(range(5)) AS v) SELECT CAST(a.v AS INTEGER) AS t, CAST(b.v AS INTEGER) AS p, count(diagnosis) AS n
    FROM g a CROSS JOIN g b LEFT JOIN preds ON diagnosis = a.v AND pred = b.v GROUP BY ALL""")
def confusion_matrix(spark, d):
    return metrics.dense(cells(spark, d))


@query(f"WITH {PREDS_SQL}, {METRICS.format(by='split,', src='preds')} SELECT split, {GRADE} FROM c GROUP BY split")
def grade_metrics(spark, d):
    return metrics.grade_metrics(cells(spark, d, ["split"]), ["split"])


def _qwk_sql(i: str, j: str, by: str) -> str:
    return f"""SELECT {by}, CASE WHEN e > 1e-9 THEN 1 - x / e END AS qwk FROM (SELECT {by}, sum(n * ({i} - {j}) ** 2) AS x,
        sum(n * {i} * {i}) + sum(n * {j} * {j}) - 2 * sum(n * {i}) * sum(n * {j}) / sum(n) AS e FROM c GROUP BY {by})"""


@query(f"WITH {PREDS_SQL}, {METRICS.format(by='split,', src='preds')} {_qwk_sql('t', 'p', 'split')}")
def qwk_fixed(spark, d):
    return metrics.qwk(cells(spark, d, ["split"]), ["split"])


_SPARSE = "(SELECT * FROM preds WHERE diagnosis <> 1 AND pred <> 1 OR stratum = 'O')"
_RANKED = f"""{METRICS.format(by='stratum,', src=_SPARSE)},
    l AS (SELECT stratum, v, row_number() OVER (PARTITION BY stratum ORDER BY v) AS r FROM (SELECT stratum, t AS v FROM c UNION SELECT stratum, p FROM c)),
    k AS (SELECT c.stratum, n, a.r AS i, b.r AS j FROM c JOIN l a ON a.stratum = c.stratum AND a.v = t JOIN l b ON b.stratum = c.stratum AND b.v = p)"""


@query(f"WITH {PREDS_SQL}, {_RANKED} {_qwk_sql('i', 'j', 'stratum').replace('FROM c', 'FROM k')}")
def qwk_observed_by_stratum(spark, d):
    rows = graded(preds(spark, d)).where("diagnosis <> 1 AND pred <> 1 OR stratum = 'O'")
    return metrics.qwk(metrics.cells(rows, "diagnosis", "pred", ["stratum"]), ["stratum"], observed=True)


@query(f"WITH {PREDS_SQL} {REFERABLE.format(by='split,', src='preds')}")
def referable_confusion(spark, d):
    return metrics.referable_confusion(cells(spark, d, ["split"]), ["split"])


@query(f"""WITH {PREDS_SQL} SELECT split, count(*) FILTER (diagnosis >= 3) AS severe_total, count(*) FILTER (diagnosis >= 3 AND pred <= 1) AS severe_missed FROM preds GROUP BY split""")
def costly_errors(spark, d):
    return metrics.costly_errors(cells(spark, d, ["split"]), ["split"])


@query(f"""WITH {PREDS_SQL}, {METRICS.format(by="stratum,", src="(SELECT unnest([stratum, 'ALL']) AS stratum, diagnosis, pred FROM preds)")},
    q AS ({_qwk_sql('t', 'p', 'stratum')}), m AS (SELECT stratum, {GRADE} FROM c GROUP BY stratum),
    r AS (SELECT stratum, sensitivity, specificity, referral_rate FROM ({REFERABLE.format(by='stratum,', src="(SELECT unnest([stratum, 'ALL']) AS stratum, diagnosis, pred FROM preds)")})),
    j AS (SELECT stratum, arg_max(t, (n, -t)) AS majority_grade, max(n) / sum(n) AS majority_acc, coalesce(sum(n) FILTER (t = 0), 0) / sum(n) AS share_no_dr
        FROM (SELECT stratum, t, sum(n) AS n FROM c GROUP BY ALL) GROUP BY stratum)
    SELECT * FROM m JOIN q USING (stratum) JOIN r USING (stratum) JOIN j USING (stratum)""")
def stratified_report(spark, d):
    return metrics.stratified_report(graded(preds(spark, d)), "diagnosis", "pred", "stratum")


@query(f"""WITH {PREDS_SQL}, c AS (SELECT diagnosis AS t, pred AS p, count(*) AS n FROM preds GROUP BY ALL)
    SELECT t AS grade, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (t = p) AS DOUBLE) / sum(n) AS recall, arg_max(p, (n, -p)) FILTER (t <> p) AS top_wrong,
    coalesce(max(n) FILTER (t <> p), 0) AS n_wrong FROM c GROUP BY t""")
def per_class_confusions(spark, d):
    return metrics.per_class(cells(spark, d))


@query(f"""WITH {EYES_SQL}, c AS (SELECT split, diagnosis, count(*) AS n FROM eyes GROUP BY ALL) SELECT split, arg_max(diagnosis, (n, -diagnosis)) AS majority_grade,
    max(n)::DOUBLE / sum(n) AS majority_acc, coalesce(sum(n) FILTER (diagnosis = 0), 0)::DOUBLE / sum(n) AS share_no_dr FROM c GROUP BY split""")
def majority_baseline(spark, d):
    return metrics.majority(metrics.cells(eyes(spark, d), "diagnosis", "diagnosis", ["split"]), ["split"])


@query(f"""WITH {EYES_SQL} SELECT diagnosis AS grade, (SELECT count(*) FROM eyes)::DOUBLE / (5 * count(*)) AS weight FROM eyes GROUP BY diagnosis""")
def class_weights(spark, d):
    return metrics.class_weights(metrics.cells(eyes(spark, d), "diagnosis", "diagnosis"))


@query(f"""WITH {PREDS_SQL}, c AS (SELECT diagnosis AS grade, count(*) AS n, count(*) FILTER (pred >= 2) AS referred FROM preds GROUP BY ALL)
    SELECT grade, n, referred, n - referred AS not_referred, CASE WHEN grade >= 2 THEN n - referred END AS missed_referable,
    CASE WHEN grade >= 2 THEN referred::DOUBLE / n END AS sensitivity, CASE WHEN grade < 2 THEN referred::DOUBLE / n END AS false_referral_fraction FROM c""")
def referral_breakdown(spark, d):
    return metrics.referral_breakdown(cells(spark, d))


@query(f"""WITH {PREDS_SQL}, x AS (SELECT unnest(['grade_' || diagnosis, 'all_referable']) AS grade, pred < 2 AS a, cand < 2 AS b FROM preds WHERE diagnosis >= 2)
    SELECT grade, count(*) AS n, count(*) FILTER (a AND b) AS both_missed, count(*) FILTER (a AND NOT b) AS baseline_only_missed,
        count(*) FILTER (NOT a AND b) AS candidate_only_missed, count(*) FILTER (NOT a AND NOT b) AS neither_missed FROM x GROUP BY grade""")
def paired_discordance(spark, d):
    return metrics.paired_discordance(graded(preds(spark, d)), "diagnosis", "pred", "cand")


@query(f"""WITH {COHORTS_SQL}, {METRICS.format(by='cohort,', src='cohorts')}, m AS (SELECT cohort, {GRADE} FROM c GROUP BY cohort), q AS ({_qwk_sql('t', 'p', 'cohort')}),
    r AS ({REFERABLE.format(by='cohort,', src='cohorts')}),
    s AS (SELECT cohort, count(*) FILTER (diagnosis >= 3) AS severe_total, count(*) FILTER (diagnosis >= 3 AND pred <= 1) AS severe_missed FROM cohorts GROUP BY cohort)
    SELECT * FROM m JOIN q USING (cohort) JOIN r USING (cohort) JOIN s USING (cohort)""")
def external_summary(spark, d):
    counted = metrics.cells(graded(cohorts(spark, d)), "diagnosis", "pred", ["cohort"])
    by = ["cohort"]
    parts = [metrics.qwk(counted, by), metrics.referable_confusion(counted, by), metrics.costly_errors(counted, by)]
    out = metrics.grade_metrics(counted, by)
    for p in parts:
        out = out.join(p, by)
    return out


@query(f"""WITH {COHORTS_SQL} SELECT cohort, count(*) AS n, count(*) FILTER (diagnosis >= 2) AS referable, count(*) FILTER (pred >= 2) AS referred,
    (p + z / 2 - h) / (1 + z) AS low, (p + z / 2 + h) / (1 + z) AS high FROM (SELECT *, 1.96::DOUBLE * sqrt(p * (1 - p) / n + z / (4 * n)) AS h FROM (
        SELECT cohort, diagnosis, pred, count(*) OVER w AS n, count(*) FILTER (pred >= 2) OVER w / count(*) OVER w AS p, 1.96::DOUBLE * 1.96::DOUBLE / count(*) OVER w AS z
        FROM cohorts WINDOW w AS (PARTITION BY cohort))) GROUP BY cohort, p, z, h""")
def wilson_intervals(spark, d):
    per = graded(cohorts(spark, d)).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("diagnosis") >= 2).alias("referable"), F.count_if(F.col("pred") >= 2).alias("referred"))
    return per.withColumn("w", S.wilson(F.col("referred"), F.col("n"))).select("cohort", "n", "referable", "referred", "w.low", "w.high")


# ---------------------------------------------------------------- joins and quality


@query(f"""WITH {EYES_SQL} SELECT split, count(*) AS n FROM eyes WHERE NOT (split = 'train' AND id_code % 7 = 0) GROUP BY split""")
def leak_filter(spark, d):
    rows = eyes(spark, d)
    return joins.drop_leaked(rows, rows.where("id_code % 7 = 0").select("id_code"), "id_code").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both, count(*) FILTER (b.doc_id IS NULL) AS left_only,
    count(*) FILTER (a.doc_id IS NULL) AS right_only FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id""")
def correspondence(spark, d):
    return joins.correspondence(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query(f"""WITH {PREDS_SQL} SELECT split, count(*) AS n, sum(candidate_raw - baseline_raw) / count(*) AS mean_diff FROM preds GROUP BY split""")
def one_to_one_join(spark, d):
    rows = preds(spark, d)
    both = joins.join_one_to_one(rows.select("id_code", "split", "baseline_raw"), rows.select("id_code", "candidate_raw"), "id_code", complete=True)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("candidate_raw") - F.col("baseline_raw")).alias("mean_diff"))


@query("""WITH a AS (SELECT doc_id, CAST(n_chars >= 1000 AS INTEGER) AS diagnosis, n_chars % 2 AS grade FROM documents), b AS (SELECT doc_id, quality AS diagnosis, toxic AS grade FROM labels)
    SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS matched, count(*) FILTER (b.doc_id IS NULL) AS only_left,
    count(*) FILTER (a.doc_id IS NULL) AS only_right, count(*) FILTER (a.doc_id = b.doc_id AND a.diagnosis IS DISTINCT FROM b.diagnosis) AS diagnosis_differs,
    count(*) FILTER (a.doc_id = b.doc_id AND a.grade IS DISTINCT FROM b.grade) AS grade_differs FROM a FULL JOIN b USING (doc_id)""")
def set_reconcile(spark, d):
    a = table(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("diagnosis"), (F.col("n_chars") % 2).alias("grade"))
    b = table(spark, d, "labels").select("doc_id", F.col("quality").alias("diagnosis"), F.col("toxic").alias("grade"))
    return joins.reconcile(a, b, "doc_id", ["diagnosis", "grade"])


@query("""SELECT coalesce(r_name, n_name) AS place, count(*) AS n FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey GROUP BY place""")
def commit_remap(spark, d):
    known = table(spark, d, "nation").join(table(spark, d, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("old"), F.col("r_name").alias("new"))
    return joins.remap(table(spark, d, "nation"), known, "n_name", "old", "new").groupBy(F.col("n_name").alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PREDS_SQL} SELECT split, count(*) AS n FROM preds WHERE patient_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY split""")
def existing_images(spark, d):
    have = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("patient_id"))
    return preds(spark, d).join(have, "patient_id", "left_semi").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DOCS_SQL} SELECT content, copies, splits, first_id, splits > 1 AS crosses FROM (SELECT content, count(*) AS copies, count(DISTINCT split) AS splits,
    min(id_code) AS first_id FROM docs GROUP BY content HAVING copies > 1)""")
def duplicate_candidates(spark, d):
    return quality.duplicate_groups(docs(spark, d), "content", "id_code", "split")


_DOC_PARTS = "CASE WHEN split IN ('src0', 'src1', 'src2', 'src3') THEN 'test' ELSE 'train' END"


@query(f"""WITH {DOCS_SQL}, p AS (SELECT id_code, content, {_DOC_PARTS} AS part FROM docs)
    SELECT id_code FROM p WHERE part = 'train' AND content IN (SELECT content FROM p WHERE part = 'test')""")
def leaked_ids(spark, d):
    parts = docs(spark, d).withColumn("part", F.when(F.col("split").isin("src0", "src1", "src2", "src3"), "test").otherwise("train"))
    return quality.leaked_ids(parts, "content", "id_code", "part", "train", ["test"])


_NOISE_SQL = """p AS (SELECT a.g, a.v AS x, b.v AS y FROM r a JOIN r b ON a.g = b.g AND a.k < b.k), s AS (SELECT count(DISTINCT g) AS groups, count(*) AS pairs,
    count(*) FILTER (x <> y) AS conflicts, sum(abs(x - y)) AS gap FROM p) SELECT groups, pairs, conflicts, conflicts::DOUBLE / nullif(pairs, 0) AS rate,
    1 - conflicts::DOUBLE / nullif(pairs, 0) AS agree, sqrt(1 - conflicts::DOUBLE / nullif(pairs, 0)) AS single_label_acc, coalesce(gap::DOUBLE / nullif(conflicts, 0), 0) AS mean_gap FROM s"""


@query(f"WITH {EYES_SQL}, r AS (SELECT patient_id || ':' || stratum AS g, id_code AS k, diagnosis AS v FROM eyes), {_NOISE_SQL}")
def label_noise(spark, d):
    grouped = eyes(spark, d).withColumn("g", F.concat_ws(":", F.col("patient_id").cast("string"), "stratum"))
    return quality.label_noise(grouped, "g", "id_code", "diagnosis")


@query(f"WITH {DOCS_SQL}, r AS (SELECT content AS g, id_code AS k, diagnosis AS v FROM docs WHERE diagnosis IS NOT NULL), {_NOISE_SQL}".replace("coalesce(gap::DOUBLE", "coalesce(gap::DOUBLE"))
def label_noise_documents(spark, d):
    return quality.label_noise(docs(spark, d), "content", "id_code", "diagnosis")


@query(f"""WITH {DOCS_SQL}, m AS (SELECT median(brightness) AS m FROM docs), s AS (SELECT median(abs(brightness - m)) AS s FROM docs, m)
    SELECT id_code, brightness, 0.6745::DOUBLE * (brightness - m) / s AS z FROM docs, m, s WHERE abs(0.6745::DOUBLE * (brightness - m) / s) > 3.5""")
def mad_outliers(spark, d):
    return quality.mad_outliers(docs(spark, d), "brightness").select("id_code", "brightness", "z")


@query("""SELECT property, count(v) AS n, min(v) AS low, median(v) AS middle, max(v) AS high, avg(v) AS mean FROM (
    SELECT 'p_size' AS property, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY property""")
def image_properties(spark, d):
    return quality.summary(table(spark, d, "part"), ["p_size", "p_retailprice"])


@query("""SELECT p_brand, p_size, n, n::DOUBLE / (SELECT count(*) FROM part) AS share FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_brand, p_size LIMIT 8)""")
def top_resolutions(spark, d):
    return quality.shares(table(spark, d, "part"), ["p_brand", "p_size"], 8)


@query(f"""WITH {COHORTS_SQL}, c AS (SELECT patient_id % 100 AS size, count(*) AS n, count(*) FILTER (diagnosis = 0)::DOUBLE / count(*) AS share_no_dr FROM cohorts GROUP BY ALL HAVING count(*) >= 50)
    SELECT * FROM (SELECT * FROM c ORDER BY share_no_dr, size LIMIT 3) UNION SELECT * FROM (SELECT * FROM c ORDER BY share_no_dr DESC, size DESC LIMIT 3)""")
def resolution_priors(spark, d):
    return quality.value_priors(cohorts(spark, d).withColumn("size", F.col("patient_id") % 100), ["size"], "diagnosis", 50, 3)


@query("""SELECT doc_id, source, 'too_short' AS issue, CAST(n_chars AS VARCHAR) AS value FROM documents WHERE n_chars < 100
    UNION ALL SELECT doc_id, source, 'too_long', CAST(n_chars AS VARCHAR) FROM documents WHERE n_chars > 10000
    UNION ALL SELECT doc_id, source, 'missing_label', 'none' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def problem_rows(spark, d):
    has = table(spark, d, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    rows = table(spark, d, "documents").join(has, "doc_id", "left")
    n = F.col("n_chars")
    return quality.problems(rows, "doc_id", "source", {"too_short": F.when(n < 100, n), "too_long": F.when(n > 10000, n), "missing_label": F.when(F.col("has").isNull(), "none")})


@query("""WITH h AS (SELECT vec_id, embedding AS e, embedding[2] > embedding[1] AS a, embedding[3] > embedding[2] AS b, embedding[5] > embedding[4] AS c,
        embedding[6] > embedding[5] AS d, embedding[8] > embedding[7] AS f, embedding[9] > embedding[8] AS g FROM embeddings),
    p AS (SELECT x.vec_id AS "left", y.vec_id AS "right", x.e AS x, y.e AS y FROM h x JOIN h y USING (a, b, c, d, f, g) WHERE x.vec_id < y.vec_id), e AS (SELECT "left", "right", unnest(x)::DOUBLE AS x, unnest(y)::DOUBLE AS y FROM p)
    SELECT "left", "right", corr, mae FROM (SELECT "left", "right", corr(x, y) AS corr, avg(abs(x - y)) AS mae FROM e GROUP BY ALL) WHERE corr >= 0.3 AND mae <= 0.2""")
def thumb_similarity(spark, d):
    rows = table(spark, d, "embeddings").withColumn("hash", S.difference_hash(F.slice("embedding", 1, 9), 3))
    return quality.similar_pairs(rows, "hash", "vec_id", "embedding", S.similarity, 0.3, 0.2)


@query("""SELECT vec_id, string_agg(CASE WHEN embedding[i + 2] > embedding[i + 1] THEN '1' ELSE '0' END, '' ORDER BY i) AS dhash
    FROM (SELECT vec_id, embedding, unnest(range(63)) AS i FROM embeddings) WHERE i % 8 <> 7 GROUP BY vec_id""")
def thumb_dhash(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.difference_hash(F.col("embedding"), 8).alias("dhash"))


# ---------------------------------------------------------------- curves and calibration

@query(f"""WITH {COHORTS_SQL}, {CURVE} SELECT cohort, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp::DOUBLE / pa AS tpr, fp::DOUBLE / na AS fpr FROM (
    SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS bt, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS bf FROM pts WINDOW w AS (PARTITION BY cohort ORDER BY score DESC))
    WHERE bt IS NULL OR bt <> 0 OR bf <> 0""")
def roc_points(spark, d):
    return curves.roc_corners(curves.roc_points(counts_of(spark, d), ["cohort"])).select("cohort", "score", "tp", "fp", "tpr", "fpr")


@query(f"""WITH {COHORTS_SQL}, {CURVE} SELECT cohort, sum(pos * ((na - fp) + neg / 2.0::DOUBLE)) / (max(pa)::DOUBLE * max(na)) AS auc FROM pts GROUP BY cohort""")
def auc_by_cohort(spark, d):
    return curves.auc(counts_of(spark, d), ["cohort"])


@query(f"""WITH {COHORTS_SQL}, {CURVE} SELECT cohort, sum(pos::DOUBLE / pa * tp / (tp + fp)) AS average_precision FROM pts GROUP BY cohort""")
def average_precision(spark, d):
    return curves.average_precision(counts_of(spark, d), ["cohort"])


@query(f"WITH {COHORTS_SQL}, {POINT} SELECT * FROM point")
def operating_point(spark, d):
    return curves.operating_point(counts_of(spark, d), ["cohort"])


@query(f"""WITH {COHORTS_SQL}, a AS (SELECT cohort, count(*) AS n, count(*) FILTER (diagnosis >= 2 AND baseline_raw >= 1.25) AS tp, count(*) FILTER (diagnosis < 2 AND baseline_raw >= 1.25) AS fp,
    count(*) FILTER (diagnosis < 2 AND baseline_raw < 1.25) AS tn, count(*) FILTER (diagnosis >= 2 AND baseline_raw < 1.25) AS fn FROM cohorts GROUP BY cohort)
    SELECT *, tp::DOUBLE / nullif(tp + fn, 0) AS sensitivity, tn::DOUBLE / nullif(tn + fp, 0) AS specificity, tp::DOUBLE / nullif(tp + fp, 0) AS ppv, (tp + fp)::DOUBLE / n AS referral_rate FROM a""")
def apply_cut(spark, d):
    return curves.apply_cut(cohorts(spark, d), ill(), "baseline_raw", F.lit(1.25), ["cohort"])


@query(f"""WITH {COHORTS_SQL}, {POINT} SELECT p.cohort AS fitted_on, k.cohort AS applied_to, cut, sum(pos) FILTER (score >= cut)::DOUBLE / sum(pos) AS sensitivity,
    coalesce(sum(neg) FILTER (score < cut), 0)::DOUBLE / sum(neg) AS specificity FROM point p JOIN k ON p.cohort <> k.cohort GROUP BY ALL""")
def site_transfer(spark, d):
    return curves.site_transfer(cohorts(spark, d), ill(), "baseline_raw", "cohort")


_PROB = "prob AS (SELECT *, 1 / (1 + exp(-(1.5::DOUBLE * baseline_raw - 2.25::DOUBLE))) AS p FROM cohorts)"
_EDGES = ", ".join(repr(e) for e in curves.bin_edges()[1:-1])
_RELIABILITY = f"""rel AS (SELECT cohort, CAST(len(list_filter([{_EDGES}]::DOUBLE[], lambda e: p > e)) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_predicted,
    avg(CAST(diagnosis >= 2 AS INTEGER)) AS observed FROM prob GROUP BY ALL)"""


def _prob(spark, d):
    return cohorts(spark, d).withColumn("p", S.sigmoid(F.lit(1.5) * F.col("baseline_raw") - F.lit(2.25)))


@query(f"WITH {COHORTS_SQL}, {_PROB}, {_RELIABILITY} SELECT *, observed - mean_predicted AS gap FROM rel")
def ece_table(spark, d):
    return curves.reliability(_prob(spark, d), ill(), "p", ["cohort"])


@query(f"WITH {COHORTS_SQL}, {_PROB}, {_RELIABILITY} SELECT cohort, sum(n * abs(observed - mean_predicted)) / sum(n) AS ece FROM rel GROUP BY cohort")
def ece(spark, d):
    return curves.ece(curves.reliability(_prob(spark, d), ill(), "p", ["cohort"]), ["cohort"])


_TS = ", ".join(repr(float(t)) for t in np.arange(0.05, 0.75, 0.05))


@query(f"""WITH {COHORTS_SQL}, {_PROB}, t AS (SELECT unnest([{_TS}]::DOUBLE[]) AS threshold), s AS (SELECT cohort, threshold, count(*) AS n, count(*) FILTER (p >= threshold AND diagnosis >= 2) AS tp,
    count(*) FILTER (p >= threshold AND diagnosis < 2) AS fp, avg(CAST(diagnosis >= 2 AS INTEGER)) AS y, threshold / (1 - threshold) AS o FROM prob, t GROUP BY ALL),
    c AS (SELECT cohort, threshold, tp::DOUBLE / n - fp::DOUBLE / n * o AS model, y - (1 - y) * o AS treat_all, 0::DOUBLE AS treat_none FROM s)
    SELECT *, model > treat_all AND model > 0 AS model_beats_both FROM c""")
def decision_curve(spark, d):
    return curves.decision_curve(_prob(spark, d), ill(), "p", ["cohort"])


@query(f"WITH {COHORTS_SQL}, {_PROB} SELECT cohort, avg(CAST(diagnosis >= 2 AS INTEGER)) - avg(p) AS observed_minus_predicted FROM prob GROUP BY cohort")
def calibration_in_the_large(spark, d):
    return curves.calibration_in_the_large(_prob(spark, d), ill(), "p", ["cohort"])


# ---------------------------------------------------------------- resampling

@query(f"""WITH {PREDS_SQL}, sums AS (SELECT patient_id, count(*) FILTER (diagnosis >= 2) AS pos, count(*) FILTER (diagnosis >= 2 AND pred >= 2) AS ta,
    count(*) FILTER (diagnosis >= 2 AND cand >= 2) AS tb, count(*) FILTER (diagnosis < 2) AS neg, count(*) FILTER (diagnosis < 2 AND pred < 2) AS na, count(*) FILTER (diagnosis < 2 AND cand < 2) AS nb
    FROM preds GROUP BY patient_id), {DRAWN}, s AS (SELECT draw, sum(pos) AS pos, sum(ta) AS ta, sum(tb) AS tb, sum(neg) AS neg, sum(na) AS na, sum(nb) AS nb
    FROM dr JOIN cl USING (place) GROUP BY draw), long AS (SELECT 'sensitivity' AS metric, CASE WHEN pos > 0 AND neg > 0 THEN (tb - ta)::DOUBLE / pos END AS value FROM s
    UNION ALL SELECT 'specificity', CASE WHEN pos > 0 AND neg > 0 THEN (nb - na)::DOUBLE / neg END FROM s
    UNION ALL SELECT 'referral', CASE WHEN pos > 0 AND neg > 0 THEN (tb - ta + na - nb)::DOUBLE / (pos + neg) END FROM s) {LIMITS}""")
def bootstrap_rates_ci(spark, d):
    s = resampled_sums(spark, d, _rate_sums())
    return resample.interval(resample.paired_rates(s), ["sensitivity", "specificity", "referral"], DRAWS)


def _rate_sums() -> dict:
    y, a, b = ill(), F.col("pred") >= 2, F.col("cand") >= 2
    return {"pos": F.count_if(y), "ta": F.count_if(y & a), "tb": F.count_if(y & b), "neg": F.count_if(~y), "na": F.count_if(~y & ~a), "nb": F.count_if(~y & ~b)}


#: Fixed value: the seed of the published draws.
SEED = 42


@query()
def bootstrap_rates_parity(spark, d):
    """The limits of the same rates over the draws of NumPy's generator."""
    rows = clusters(spark, d, _rate_sums())
    size = rows.count()
    s = resample.weighed(rows, list(_rate_sums()), resample.packed_generator_draws(spark, size, DRAWS, SEED, shared=True), size)
    return resample.interval(resample.paired_rates(s), ["sensitivity", "specificity", "referral"], DRAWS)


_MOMENTS = {"n": "1", "t": "diagnosis", "tt": "diagnosis * diagnosis", "a": "pred", "aa": "pred * pred", "ta": "diagnosis * pred", "b": "cand", "bb": "cand * cand", "tb": "diagnosis * cand"}


@query(f"""WITH {PREDS_SQL}, sums AS (SELECT patient_id, {", ".join(f"sum({e}) AS {k}" for k, e in _MOMENTS.items())} FROM preds GROUP BY patient_id), {DRAWN},
    s AS (SELECT draw, {", ".join(f"sum({k})::DOUBLE AS {k}" for k in _MOMENTS)} FROM dr JOIN cl USING (place) GROUP BY draw),
    long AS (SELECT 'delta_qwk' AS metric, ({kappa_sql("b")}) - ({kappa_sql("a")}) AS value FROM s) {LIMITS}""")
def bootstrap_qwk_ci(spark, d):
    s = resampled_sums(spark, d, {k: F.sum(F.expr(e)) for k, e in _MOMENTS.items()})
    c = lambda x: F.col(x).cast("double")
    kappa = lambda p: 1 - F.try_divide(c("tt") + c(p + p) - 2 * c("t" + p), c("tt") + c(p + p) - 2 * c("t") * c(p) / c("n"))
    return resample.interval(s.select("draw", (kappa("b") - kappa("a")).alias("delta_qwk")), ["delta_qwk"], DRAWS)


_ARMS = ("baseline", "control", "candidate")
#: The contrasts, as the second arm's area less the first's.
_CONTRASTS = {"candidate_minus_baseline": ("baseline", "candidate"), "candidate_minus_control": ("control", "candidate"), "control_minus_baseline": ("baseline", "control")}


@query(f"""WITH {PREDS_SQL}, sums AS (SELECT DISTINCT patient_id FROM preds), {DRAWN}, hits AS (SELECT draw, place, count(*) AS times FROM dr GROUP BY ALL),
    arms AS (SELECT patient_id, diagnosis, unnest(['baseline', 'control', 'candidate']) AS arm, unnest([baseline_raw, control_raw, candidate_raw]) AS score FROM preds),
    r AS (SELECT place, arm, score, count(*) FILTER (diagnosis >= 2) AS pos, count(*) FILTER (diagnosis < 2) AS neg FROM cl JOIN arms USING (patient_id) GROUP BY ALL),
    w AS (SELECT draw, arm, score, sum(pos * times) AS pos, sum(neg * times) AS neg FROM hits JOIN r USING (place) GROUP BY ALL),
    cum AS (SELECT draw, arm, pos, neg, coalesce(sum(neg) OVER (PARTITION BY draw, arm ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w),
    auc AS (SELECT draw, arm, sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auc FROM cum GROUP BY ALL),
    wide AS (SELECT max(auc) FILTER (arm = 'baseline') AS a, max(auc) FILTER (arm = 'control') AS c, max(auc) FILTER (arm = 'candidate') AS b FROM auc GROUP BY draw),
    long AS (SELECT unnest(['candidate_minus_baseline', 'candidate_minus_control', 'control_minus_baseline']) AS metric, unnest([b - a, b - c, c - a]) AS value FROM wide) {LIMITS}""")
def bootstrap_auc_ci(spark, d):
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}_raw").alias("score")) for a in _ARMS])).alias("x")
    rows = preds(spark, d).select("patient_id", ill().alias("ill"), arms).select("patient_id", "ill", "x.arm", "x.score")
    values = resample.resampled_auc(rows, "patient_id", F.col("ill"), "score", "arm", DRAWS)
    wide = values.groupBy("draw").agg(*[F.max(F.when(F.col("arm") == a, F.col("auc"))).alias(a) for a in _ARMS])
    return resample.interval(wide.select("draw", *[(F.col(b) - F.col(a)).alias(n) for n, (a, b) in _CONTRASTS.items()]), list(_CONTRASTS), DRAWS)


@query(f"""WITH {PREDS_SQL}, a AS (SELECT split, count(*) AS n, avg(CAST(cand = diagnosis AS INTEGER)) - avg(CAST(pred = diagnosis AS INTEGER)) AS accuracy_delta,
    count(*) FILTER (pred <> diagnosis AND cand = diagnosis) AS fixed, count(*) FILTER (pred = diagnosis AND cand <> diagnosis) AS broken FROM preds GROUP BY split) SELECT * FROM a""")
def paired_delta(spark, d):
    right = lambda c: F.col(c) == F.col("diagnosis")
    return graded(preds(spark, d)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(right("cand").cast("int")) - F.avg(right("pred").cast("int"))).alias("accuracy_delta"),
        F.count_if(~right("pred") & right("cand")).alias("fixed"), F.count_if(right("pred") & ~right("cand")).alias("broken"),
    )


# ---------------------------------------------------------------- splits

_FOLDS = f"folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY diagnosis ORDER BY CAST('0x' || substr(md5('42:' || id_code), 1, 8) AS BIGINT), id_code) - 1) % 5 + 1 AS INTEGER) AS k FROM eyes)"


@query(f"WITH {EYES_SQL}, {_FOLDS} SELECT id_code, diagnosis, k AS fold FROM folds")
def kfold_assignment(spark, d):
    return splits.stratified_folds(eyes(spark, d).drop("fold"), "id_code", ["diagnosis"], 5).select("id_code", "diagnosis", "fold")


@query(f"WITH {EYES_SQL}, {_FOLDS} SELECT k AS fold, diagnosis, count(*) AS n FROM folds GROUP BY ALL")
def fold_balance(spark, d):
    return splits.stratified_folds(eyes(spark, d).drop("fold"), "id_code", ["diagnosis"], 5).groupBy("fold", "diagnosis").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EYES_SQL}, g AS (SELECT patient_id, max(diagnosis) AS top, count(*) AS size FROM eyes GROUP BY ALL),
    f AS (SELECT patient_id, CAST((row_number() OVER (PARTITION BY top, size ORDER BY CAST('0x' || substr(md5('42:' || patient_id), 1, 8) AS BIGINT), patient_id) - 1) % 5 + 1 AS INTEGER) AS fold FROM g)
    SELECT f.fold, count(*) AS eyes, count(DISTINCT patient_id) AS groups, count(*) FILTER (diagnosis >= 2) AS referable FROM eyes JOIN f USING (patient_id) GROUP BY f.fold""")
def group_kfold(spark, d):
    return splits.group_folds(eyes(spark, d).drop("fold"), "patient_id", "diagnosis", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("eyes"), F.countDistinct("patient_id").alias("groups"), F.count_if(ill()).alias("referable"))


def _exams(spark, d):
    return eyes(spark, d).withColumn("exam", F.floor(F.col("id_code") / 2))


_EXAMS = "ex AS (SELECT *, id_code // 2 AS exam FROM eyes), pt AS (SELECT exam, count(*) AS images, list_sort(list(DISTINCT split)) AS parts FROM ex GROUP BY exam)"


@query("""SELECT o_orderkey AS id_code, 'exam:' || sha256(concat_ws(chr(0), least(a, b), greatest(a, b))) AS exam FROM (
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE o_orderkey - 1 END AS VARCHAR) AS b FROM orders)""")
def exam_keys(spark, d):
    other = F.when(F.col("id_code") % 2 == 0, F.col("id_code") + 1).otherwise(F.col("id_code") - 1)
    return eyes(spark, d).select("id_code", S.pair_key(F.col("id_code").cast("string"), other.cast("string")).alias("exam"))


@query(f"""WITH {EYES_SQL}, {_EXAMS} SELECT count(*) AS examinations, count(*) FILTER (images = 2) AS complete_pairs, count(*) FILTER (images = 1) AS single_eyes,
    count(*) FILTER (len(parts) > 1) AS crossing, count(*) FILTER (len(parts) > 1 AND list_contains(parts, 'test')) AS test_crossing, count(*) FILTER (len(parts) > 1) = 0 AS disjoint FROM pt""")
def exam_audit(spark, d):
    return splits.examination_audit(_exams(spark, d), "exam", "split")


@query(f"WITH {EYES_SQL}, {_EXAMS} SELECT array_to_string(parts, ' + ') AS combination, count(*) AS examinations FROM pt GROUP BY combination")
def exam_combinations(spark, d):
    return splits.part_combinations(_exams(spark, d), "exam", "split")


@query(f"""WITH {EYES_SQL}, {_EXAMS} SELECT split AS part, count(*) AS eyes, count(DISTINCT exam) AS examinations, count(*) FILTER (diagnosis >= 2) AS referable,
    {", ".join(f"count(*) FILTER (diagnosis = {g}) AS grade_{g}" for g in range(5))} FROM ex GROUP BY split""")
def split_plan(spark, d):
    return splits.split_plan(_exams(spark, d), "split", "exam", "diagnosis")


@query(f"WITH {EYES_SQL} SELECT split AS old_part, CASE WHEN fold = 1 THEN 'test' ELSE 'train' END AS new_part, count(*) AS n FROM eyes GROUP BY ALL")
def transitions(spark, d):
    return splits.transitions(eyes(spark, d).withColumn("new", F.when(F.col("fold") == 1, "test").otherwise("train")), "split", "new")


_NAMES = "names AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'd' || (o_orderkey % 97) || '_x' ELSE 'IM' || CAST(o_orderkey - o_orderkey % 7 // 6 AS VARCHAR) END AS name FROM orders)"


@query(f"""WITH {_NAMES}, im AS (SELECT id, name, CAST(substr(name, 3) AS BIGINT) AS k FROM names WHERE name LIKE 'IM%'),
    br AS (SELECT id, k, name, CASE WHEN k = lag(k) OVER w + 1 THEN 0 ELSE 1 END AS b FROM im WINDOW w AS (ORDER BY k, name, id)),
    ch AS (SELECT k, 'im:' || CAST(sum(b) OVER (ORDER BY k, name, id) - 1 AS BIGINT) AS grp FROM br)
    SELECT grp AS "group", count(*) AS n FROM (SELECT grp FROM ch UNION ALL SELECT 'date:' || split_part(name, '_', 1) FROM names WHERE name NOT LIKE 'IM%') GROUP BY grp""")
def filename_islands(spark, d):
    k = F.col("id_code")
    name = F.when(k % 4 == 0, F.concat(F.lit("d"), (k % 97).cast("string"), F.lit("_x"))).otherwise(F.concat(F.lit("IM"), (k - F.floor(k % 7 / 6)).cast("string")))
    return splits.filename_groups(eyes(spark, d).select(name.alias("name")), "name").groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EYES_SQL} SELECT id_code, diagnosis FROM (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY id_code) AS r FROM eyes) WHERE r <= 3")
def first_k_per_group(spark, d):
    return splits.first_k(eyes(spark, d), ["diagnosis"], ["id_code"], 3).select("id_code", "diagnosis")


@query(f"""WITH {PREDS_SQL} SELECT id_code, diagnosis FROM (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY baseline_raw, id_code) AS r,
    count(*) OVER (PARTITION BY diagnosis) AS c FROM preds) WHERE r = c // 2 + 1""")
def middle_row(spark, d):
    return splits.middle_row(preds(spark, d), ["diagnosis"], ["baseline_raw", "id_code"]).select("id_code", "diagnosis")


@query(f"WITH {PREDS_SQL} SELECT id_code, abs(baseline_raw - diagnosis) AS error FROM preds ORDER BY error DESC, id_code LIMIT 5")
def top_errors(spark, d):
    return preds(spark, d).select("id_code", F.abs(F.col("baseline_raw") - F.col("diagnosis")).alias("error")).orderBy(F.desc("error"), "id_code").limit(5)


# ---------------------------------------------------------------- runs, audits, statistics


@query(f"WITH {RUNS_SQL} SELECT variant, count(*) AS folds, avg(metric) AS metric_mean, coalesce(stddev_samp(metric), 0) AS metric_std FROM runs GROUP BY variant")
def fold_summary(spark, d):
    return audits.fold_summary(runs(spark, d), ["variant"], ["metric"])


@query(f"WITH {RUNS_SQL} SELECT variant, metric_mean, row_number() OVER (ORDER BY metric_mean DESC, variant) AS place FROM (SELECT variant, avg(metric) AS metric_mean FROM runs GROUP BY variant)")
def leaderboard(spark, d):
    means = audits.fold_summary(runs(spark, d), ["variant"], ["metric"])
    return means.select("variant", "metric_mean", F.row_number().over(Window.orderBy(F.desc("metric_mean"), "variant")).cast("long").alias("place"))


@query(f"""WITH {RUNS_SQL}, v AS (SELECT DISTINCT variant FROM runs) SELECT a.variant, count(*) AS n, avg(b.metric - a.metric) AS mean_diff, stddev_samp(b.metric - a.metric) AS sd_diff,
    count(*) FILTER (b.metric > a.metric) AS won, avg(b.metric - a.metric) * sqrt(count(*)) / nullif(stddev_samp(b.metric - a.metric), 0) AS t
    FROM runs a JOIN runs b ON a.fold = b.fold AND b.variant = (SELECT min(variant) FROM v) AND a.variant <> b.variant GROUP BY a.variant""")
def variant_pivot(spark, d):
    rows = runs(spark, d)
    least = Window.partitionBy("fold").orderBy("variant")
    ranked = rows.withColumns({"base": F.first("metric").over(least), "base_variant": F.first("variant").over(least)})
    return stats.paired_t(ranked.where("variant <> base_variant"), "metric", "base", ["variant"])


@query(f"""WITH {RUNS_SQL}, f AS (SELECT variant, count(*) AS folds, min(fold) = 1 AND max(fold) = count(*) AND count(DISTINCT fold) = count(*) AS contiguous, avg(metric) AS mean,
    coalesce(stddev_samp(metric), 0) AS std FROM runs GROUP BY variant), r AS (SELECT *, round(mean, 4) + CASE WHEN variant = (SELECT min(variant) FROM runs) THEN 0.01 ELSE 0 END AS reported_mean, round(std, 4) AS reported_std FROM f)
    SELECT *, contiguous AND abs(mean - reported_mean) <= 5.0e-5 AND abs(std - reported_std) <= 5.0e-5 AS passed FROM r""")
def sweep_audit(spark, d):
    folds = runs(spark, d)
    s = audits.fold_summary(folds, ["variant"], ["metric"])
    tampered = F.when(F.col("variant") == F.min("variant").over(Window.partitionBy(F.lit(1))), 0.01).otherwise(0.0)
    reported = s.select("variant", (F.round("metric_mean", 4) + tampered).alias("mean"), F.round("metric_std", 4).alias("std"))
    return audits.sweep_audit(folds, reported, ["variant"], "metric")


_HISTORY = "history AS (SELECT event_type AS variant, CAST(user_id % 30 + 1 AS INTEGER) AS epoch, avg(value) AS value FROM events GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_HISTORY}, walk AS (
        SELECT variant, epoch, value AS best, epoch AS top, epoch AS stopped, 0 AS waited FROM history WHERE epoch = 1
        UNION ALL SELECT h.variant, h.epoch, CASE WHEN h.value > best THEN h.value ELSE best END, CASE WHEN h.value > best THEN h.epoch ELSE top END, h.epoch,
            CASE WHEN h.value > best THEN 0 ELSE waited + 1 END FROM walk w JOIN history h ON h.variant = w.variant AND h.epoch = w.epoch + 1 WHERE waited < 7)
    SELECT variant, arg_max(top, epoch) AS best_epoch, arg_max(best, epoch) AS best, max(stopped) AS stopped_at FROM walk GROUP BY variant""")
def early_stopping(spark, d):
    history = table(spark, d, "events").groupBy(F.col("event_type").alias("variant"), (F.col("user_id") % 30 + 1).cast("int").alias("epoch")).agg(F.avg("value").alias("value"))
    return audits.best_epoch(history, ["variant"], 7)


@query(f"""WITH {EYES_SQL}, w AS (SELECT sha256('id_code=' || id_code || ';diagnosis=' || diagnosis || ';split=' || split) AS h FROM eyes),
    s AS (SELECT count(*) AS "rows", {", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS HUGEINT)) AS VARCHAR) AS w{i}" for i in range(8))} FROM w)
    SELECT "rows", sha256("rows" || ':' || {" || ':' || ".join(f"w{i}" for i in range(8))}) AS fingerprint FROM s""")
def label_fingerprint(spark, d):
    return audits.fingerprint(eyes(spark, d), "id_code", ["diagnosis", "split"])


@query(f"""WITH {COHORTS_SQL}, c AS (SELECT cohort, count(*) AS n, count(*) FILTER (diagnosis >= 2) AS referable FROM cohorts GROUP BY cohort)
    SELECT cohort, n + CAST(cohort = 'ASIA' AS INTEGER) AS n, referable - CAST(cohort = 'EUROPE' AS INTEGER) AS referable, cohort NOT IN ('ASIA', 'EUROPE') AS consistent FROM c""")
def distribution_audit(spark, d):
    """Reports of each cohort, two of which are broken: one by its size, one by its referable count."""
    per = cohorts(spark, d).groupBy("cohort", "diagnosis").agg(F.count(F.lit(1)).alias("k"))
    counts = F.map_from_entries(F.collect_list(F.struct(F.col("diagnosis").cast("string"), "k")))
    reports = per.groupBy("cohort").agg(F.sum("k").alias("n"), F.sum(F.when(ill(), F.col("k")).otherwise(0)).alias("referable"), counts.alias("counts"))
    off = lambda name: F.when(F.col("cohort") == name, 1).otherwise(0)
    broken = reports.withColumns({"n": F.col("n") + off("ASIA"), "referable": F.col("referable") - off("EUROPE")})
    return audits.distribution_audit(broken).drop("counts")


_RANKS = """per AS (SELECT {v} AS value, {g} AS grp, count(*) AS n FROM {src} GROUP BY ALL), ties AS (SELECT value, sum(n) AS ties FROM per GROUP BY value),
    ranks AS (SELECT value, ties, coalesce(sum(ties) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (ties + 1) / 2.0::DOUBLE AS rank FROM ties)"""


@query(f"""WITH {_RANKS.format(v="p_retailprice", g="p_size % 5", src="part")} SELECT CAST(grp AS BIGINT) AS "group", value, n, CAST(ties AS BIGINT) AS ties, rank FROM per JOIN ranks USING (value)""")
def midranks(spark, d):
    rows = table(spark, d, "part").withColumn("g", (F.col("p_size") % 5).cast("long"))
    return stats.mid_ranks(rows, "p_retailprice", "g")


@query(f"""WITH {_RANKS.format(v="p_retailprice", g="p_size % 5", src="part")}, g AS (SELECT grp, sum(n) AS n, sum(rank * n) AS r FROM per JOIN ranks USING (value) GROUP BY grp),
    t AS (SELECT sum(ties::DOUBLE ** 3 - ties) AS t FROM ranks), s AS (SELECT sum(n)::DOUBLE AS n, sum(r * r / n) AS q, count(*) AS groups FROM g)
    SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, groups FROM s, t""")
def kruskal_h(spark, d):
    return stats.kruskal(table(spark, d, "part").withColumn("g", (F.col("p_size") % 5).cast("long")), "p_retailprice", "g")


@query(f"""WITH {_RANKS.format(v="p_retailprice", g="p_size % 5 = 0", src="part")}, s AS (SELECT sum(rank * n) FILTER (grp) AS r, sum(n) FILTER (grp)::DOUBLE AS n1, sum(n) FILTER (NOT grp)::DOUBLE AS n2 FROM per JOIN ranks USING (value)),
    t AS (SELECT sum(ties::DOUBLE ** 3 - ties) AS t FROM ranks), u AS (SELECT r - n1 * (n1 + 1) / 2 AS u, n1, n2, t, n1 + n2 AS n FROM s, t)
    SELECT u, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, (u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))) AS z FROM u""")
def mann_whitney_u(spark, d):
    rows = table(spark, d, "part").withColumn("g", F.when(F.col("p_size") % 5 == 0, "a").otherwise("b"))
    return stats.mann_whitney(rows, "p_retailprice", "g", "a").select("u", "n1", "n2", "z")


@query(f"""WITH {EYES_SQL}, f AS (SELECT id_code, diagnosis, f, diagnosis + (CAST('0x' || substr(md5('f' || f || ':' || id_code), 1, 8) AS BIGINT) % 1000 / 1000.0::DOUBLE - 0.5) * 2 AS raw
    FROM eyes, (SELECT unnest(range(5)) AS f)), e AS (SELECT id_code, diagnosis, avg(raw) AS raw FROM f GROUP BY ALL)
    SELECT diagnosis, CAST((raw >= 0.5)::INTEGER + (raw >= 1.5)::INTEGER + (raw >= 2.5)::INTEGER + (raw >= 3.5)::INTEGER AS INTEGER) AS grade, count(*) AS n FROM e GROUP BY ALL""")
def fold_ensemble(spark, d):
    folds = eyes(spark, d).select("id_code", "diagnosis", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("f"))
    h = S.hash32(F.concat(F.lit("f"), F.col("f").cast("string"), F.lit(":"), F.col("id_code").cast("string")))
    scored = folds.withColumn("raw", F.col("diagnosis") + ((h % 1000) / F.lit(1000.0) - 0.5) * 2)
    mean = audits.fold_means(scored, "id_code", "diagnosis", "f")
    return mean.groupBy("diagnosis", S.digitize(F.col("raw")).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PREDS_SQL} SELECT arm, round(avg(raw), 9) AS mean_raw, count(*) AS n FROM (SELECT unnest(['baseline', 'candidate', 'control']) AS arm, unnest([baseline_raw, candidate_raw, control_raw]) AS raw FROM preds) GROUP BY arm""")
def arms_long(spark, d):
    long = preds(spark, d).unpivot("id_code", ["baseline_raw", "candidate_raw", "control_raw"], "arm", "raw")
    return long.groupBy(F.split_part("arm", F.lit("_"), F.lit(1)).alias("arm")).agg(F.round(F.avg("raw"), 9).alias("mean_raw"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PREDS_SQL} SELECT split, unnest(range(0, 101, 5)) AS percent, unnest(quantile_cont(abs(baseline_raw - candidate_raw), [{", ".join(str(i / 20) for i in range(21))}])) AS spread FROM preds GROUP BY split""")
def spread_percentiles(spark, d):
    at = [i / 20 for i in range(21)]
    off = preds(spark, d).select("split", F.abs(F.col("baseline_raw") - F.col("candidate_raw")).alias("off"))
    per = quantiles(off, "off", at, ["split"])
    return per.select("split", F.posexplode("q").alias("i", "spread")).select("split", (F.col("i") * 5).cast("long").alias("percent"), "spread")


@query(f"""WITH RECURSIVE {PREDS_SQL}, k AS (SELECT 0 AS g, baseline_raw AS score, count(*) FILTER (diagnosis >= 2) AS pos, count(*) FILTER (diagnosis < 2) AS neg
        FROM preds WHERE split <> 'test' GROUP BY ALL), {fit_sql("k", "g")} SELECT slope, intercept FROM fitted""")
def platt_fit(spark, d):
    return stats.platt(preds(spark, d).where("split <> 'test'"), ill(), "baseline_raw")


@query()
def threshold_search(spark, d):
    cuts, kappa = stats.optimise_cuts(preds(spark, d).where("split <> 'test'"), "diagnosis", "baseline_raw")
    return spark.createDataFrame([([float(c) for c in cuts], float(kappa))], "cuts array<double>, qwk double")


@query()
def metadata_forest(spark, d):
    rows = table(spark, d, "part").withColumn("grade", (F.col("p_size") % 5).cast("int"))
    dealt = splits.row_order_folds(rows, "p_partkey", "grade", 5)
    counted = stats.metadata_forest(dealt, ["p_size", "p_retailprice"], "grade", "fold")
    return metrics.grade_metrics(counted)
