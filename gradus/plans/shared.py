"""What the query modules share: graded rows, counts, and pieces of SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import scalars as S
from gradus.operators import curves, metrics, resample
from gradus.plans.adapters import cohorts, preds

#: Draws of a bootstrap, as many as the published intervals rest on.
DRAWS = 2000


def graded(df: DataFrame) -> DataFrame:
    return df.withColumns({"pred": S.digitize(F.col("baseline_raw")), "cand": S.digitize(F.col("candidate_raw"))})


def cells(spark: SparkSession, d: str, by: list[str] | None = None, pred: str = "pred") -> DataFrame:
    return metrics.cells(graded(preds(spark, d)), "diagnosis", pred, by or [])


def ill() -> Column:
    return F.col("diagnosis") >= 2


def counts_of(spark: SparkSession, d: str) -> DataFrame:
    return curves.score_counts(cohorts(spark, d), ill(), "baseline_raw", ["cohort"])


def clusters(spark: SparkSession, d: str, sums: dict) -> DataFrame:
    """A row for each patient with the additive columns ``sums``, numbered."""
    rows = graded(preds(spark, d))
    return resample.numbered(rows.groupBy("patient_id").agg(*[c.alias(n) for n, c in sums.items()]), "patient_id")


def resampled_sums(spark: SparkSession, d: str, sums: dict) -> DataFrame:
    return resample.resampled(clusters(spark, d, sums), list(sums), DRAWS)


METRICS = """c AS (SELECT {by} diagnosis AS t, pred AS p, count(*)::DOUBLE AS n FROM {src} GROUP BY ALL)"""
_RECALLS = ", ".join(f"sum(n) FILTER (t = {g} AND p = {g}) / nullif(sum(n) FILTER (t = {g}), 0) AS recall_grade_{g}" for g in range(5))
_HITS, _SHOWN = "coalesce(sum(n) FILTER (t = {g} AND p = {g}), 0)", "coalesce(sum(n) FILTER (t = {g}), 0) + coalesce(sum(n) FILTER (p = {g}), 0)"
_F1 = " + ".join(f"coalesce(2 * {_HITS} / nullif({_SHOWN}, 0), 0)".format(g=g) for g in range(5))
GRADE = f"CAST(sum(n) AS BIGINT) AS n, sum(n) FILTER (t = p) / sum(n) AS accuracy, ({_F1}) / 5 AS macro_f1, {_RECALLS}"

REFERABLE = """SELECT {by} tp, fp, tn, fn, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS sensitivity, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity,
    CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS "precision", CAST(tp + fp AS DOUBLE) / nullif(tp + fp + tn + fn, 0) AS referral_rate FROM (
    SELECT {by} count(*) FILTER (diagnosis >= 2 AND pred >= 2) AS tp, count(*) FILTER (diagnosis < 2 AND pred >= 2) AS fp,
    count(*) FILTER (diagnosis < 2 AND pred < 2) AS tn, count(*) FILTER (diagnosis >= 2 AND pred < 2) AS fn FROM {src} GROUP BY ALL)"""

CURVE = """k AS (SELECT cohort, baseline_raw AS score, count(*) FILTER (diagnosis >= 2) AS pos, count(*) FILTER (diagnosis < 2) AS neg FROM cohorts GROUP BY ALL),
    pts AS (SELECT cohort, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY cohort) AS pa, sum(neg) OVER (PARTITION BY cohort) AS na
        FROM k WINDOW w AS (PARTITION BY cohort ORDER BY score DESC))"""
_BENDS = "lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS bt, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS bf"
POINT = f"""{CURVE}, corner AS (SELECT *, {_BENDS} FROM pts WINDOW w AS (PARTITION BY cohort ORDER BY score DESC)),
    point AS (SELECT cohort, max(score) AS cut, arg_max(tp::DOUBLE / pa, score) AS sensitivity, 1 - arg_max(fp::DOUBLE / na, score) AS specificity
        FROM corner WHERE (bt IS NULL OR bt <> 0 OR bf <> 0) AND tp::DOUBLE / pa >= 0.9 GROUP BY cohort)"""

DRAWN = f"""cl AS (SELECT *, row_number() OVER (ORDER BY patient_id) - 1 AS place, count(*) OVER () AS c FROM sums),
    dr AS (SELECT draw, CAST('0x' || substr(md5(draw || ':' || place), 1, 8) AS BIGINT) % c AS place FROM cl, (SELECT unnest(range({DRAWS})) AS draw))"""
LIMITS = f"""SELECT metric, count(value) AS valid, CASE WHEN count(value) >= 0.8 * {DRAWS} THEN quantile_cont(value, 0.025) END AS low,
    CASE WHEN count(value) >= 0.8 * {DRAWS} THEN quantile_cont(value, 0.975) END AS high FROM long GROUP BY metric"""


def kappa_sql(p: str) -> str:
    return f"1 - (tt + {p}{p} - 2 * t{p}) / nullif(tt + {p}{p} - 2 * t * {p} / n, 0)"


def fit_sql(counts: str, by: str) -> str:
    """Newton steps of the penalised logistic fit on ``counts`` (by, score, pos, neg), as ``fitted`` (by, slope, intercept)."""
    return f"""steps AS (SELECT {by}, 0 AS i, 0::DOUBLE AS slope, 0::DOUBLE AS intercept FROM {counts} GROUP BY {by}
        UNION ALL SELECT {by}, i + 1, slope - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), intercept - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
            SELECT {by}, i, slope, intercept, sum(((pos + neg) * p - pos) * score) + slope AS g0, sum((pos + neg) * p - pos) AS g1,
                sum((pos + neg) * p * (1 - p) * score * score) + 1 AS h00, sum((pos + neg) * p * (1 - p) * score) AS h01, sum((pos + neg) * p * (1 - p)) AS h11
            FROM (SELECT s.{by}, i, slope, intercept, score, pos, neg, 1 / (1 + exp(-(slope * score + intercept))) AS p FROM steps s JOIN {counts} x ON x.{by} = s.{by} WHERE i < 25)
            GROUP BY {by}, i, slope, intercept)),
    fitted AS (SELECT {by}, slope, intercept FROM steps WHERE i = 25)"""
