"""Views of the driver's tables in the shapes that the operators take, as plans and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.scalars import hash32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noisy(salt: str, width: float):
    """The grade with uniform noise of the given width, from a hash of salt and id."""
    h = hash32(F.concat(F.lit(salt), F.col("id_code").cast("string")))
    return F.col("diagnosis") + ((h % 1000).cast("double") / F.lit(1000.0) - F.lit(0.5)) * F.lit(width)


def eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hash32(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id_code"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("diagnosis"),
        F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("stratum"),
        F.when(h % 10 < 8, "train").when(h % 10 == 8, "valid").otherwise("test").alias("split"), (h % 5 + 1).alias("fold"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = {"baseline_raw": noisy("b", 3.0), "candidate_raw": noisy("a", 1.6), "control_raw": noisy("c", 2.4)}
    return eyes(spark, sf_dir).withColumns(scores)


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("n_nationkey"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", F.col("r_name").alias("cohort"))
    return preds(spark, sf_dir).join(customer, "patient_id").join(places, "n_nationkey").drop("n_nationkey")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id_code"), F.col("l_returnflag").alias("split"), (F.col("l_linenumber") - 1).alias("diagnosis"),
        (F.col("l_quantity") > 25).alias("is_referable"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("diagnosis"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"), F.col("n_chars").cast("double").alias("brightness"), F.col("source").alias("split")).join(labels, "doc_id", "left").withColumnRenamed("doc_id", "id_code")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = (F.col("user_id") % 5 + 1).cast("int")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant"), fold.alias("fold")).agg(F.avg("value").alias("metric"), F.count(F.lit(1)).alias("n"))


def _h(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


def _raw(salt: str, width: float) -> str:
    return f"diagnosis + (CAST({_h(f"'{salt}' || CAST(id_code AS VARCHAR)")} % 1000 AS DOUBLE) / 1000::DOUBLE - 0.5::DOUBLE) * {width}::DOUBLE"


EYES_SQL = f"""hashed AS (SELECT *, {_h("CAST(o_orderkey AS VARCHAR)")} AS h FROM orders),
eyes AS (SELECT o_orderkey AS id_code, 5 - CAST(left(o_orderpriority, 1) AS INTEGER) AS diagnosis, o_custkey AS patient_id, o_orderstatus AS stratum,
    CASE WHEN h % 10 < 8 THEN 'train' WHEN h % 10 = 8 THEN 'valid' ELSE 'test' END AS split, h % 5 + 1 AS fold FROM hashed)"""
DIGIT_SQL = "(CAST({0} >= 0.5 AS INTEGER) + CAST({0} >= 1.5 AS INTEGER) + CAST({0} >= 2.5 AS INTEGER) + CAST({0} >= 3.5 AS INTEGER))"
PREDS_SQL = f"""{EYES_SQL},
scored AS (SELECT *, {_raw("b", 3.0)} AS baseline_raw, {_raw("a", 1.6)} AS candidate_raw, {_raw("c", 2.4)} AS control_raw FROM eyes),
preds AS (SELECT *, {DIGIT_SQL.format("baseline_raw")} AS pred, {DIGIT_SQL.format("candidate_raw")} AS cand FROM scored)"""
COHORTS_SQL = f"""{PREDS_SQL},
cohorts AS (SELECT preds.*, r_name AS cohort FROM preds JOIN customer ON c_custkey = patient_id JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey)"""
LINES_SQL = "lines AS (SELECT l_partkey AS id_code, l_returnflag AS split, l_linenumber - 1 AS diagnosis, l_quantity > 25 AS is_referable FROM lineitem)"
DOCS_SQL = """docs AS (SELECT documents.doc_id AS id_code, sha256(text) AS content, CAST(n_chars AS DOUBLE) AS brightness, source AS split, quality AS diagnosis
    FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id)"""
RUNS_SQL = "runs AS (SELECT event_type AS variant, CAST(user_id % 5 + 1 AS INTEGER) AS fold, avg(value) AS metric, count(*) AS n FROM events GROUP BY ALL)"
