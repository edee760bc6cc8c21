"""Label, prediction, pair and run tables from files, with explicit schemas; broken contracts raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gradus.functions.scalars import grade_name, referable, stem
from gradus.sources.formats import FOLDS, FoldArchives
from gradus.operators.checks import ContractError, is_cluster, is_grade, is_safe_id, is_whole_grade, not_exactly_one, require, require_columns, require_labels, require_unique, valid_cuts


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """A delimited file as strings, by the header's names without byte-order mark and outer blanks; only ``columns`` if given.

    All columns stay text, so that a contract sees what the file says: ``2.0`` is not the grade 2.
    """
    header = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    names = [c.lstrip("﻿").strip() for c in header.columns]
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    rows = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", True).csv(path).toDF(*names)
    if columns is None:
        return rows
    missing = [c for c in columns if c not in names]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return rows.select(*columns)


def load_raw_labels(spark: SparkSession, path: str, split: str, image_root: str = "images") -> DataFrame:
    """Raw (id_code, diagnosis) of one split with the derived columns; rows without id or grade are left out, as in the raw files."""
    raw = read_text_table(spark, path, ["id_code", "diagnosis"]).dropna(subset=["id_code", "diagnosis"])
    name = F.concat(F.trim("id_code"), F.lit(".png"))
    return raw.select(
        F.trim("id_code").alias("id_code"), F.col("diagnosis").cast("int").alias("diagnosis"), grade_name(F.col("diagnosis").cast("int")).alias("diagnosis_label"),
        referable(F.col("diagnosis").cast("int")).alias("is_referable"), F.lit(split).alias("split"), name.alias("image_file"), F.concat_ws("/", F.lit(image_root), F.lit(split), name).alias("image_uri"),
    )


def load_labels(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """(id_code, diagnosis, split) under the label contract, from CSV, Parquet or a table."""
    if format == "csv":
        rows = read_text_table(spark, path, ["id_code", "diagnosis", "split"])
        require(rows, {"diagnosis": F.col("diagnosis").rlike("^[0-4]$")})
        rows = rows.withColumn("diagnosis", F.col("diagnosis").cast("int"))
    else:
        rows = spark.table(path) if format == "table" else spark.read.parquet(path)
    require_labels(rows)
    return rows


def broken_lines(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, line, record) of the lines of a delimited file that do not have the header's number of fields.

    The CSV reader fills such rows with nulls or cuts them off. A line is a record here: a quoted field must end in it. Blank
    lines are none; ``line`` counts from 1, the header included.
    """
    header = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    names = [f"c{i}" for i in range(len(header.columns))]
    schema = ", ".join(f"{c} string" for c in [*names, "_broken"])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy("file", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # A row for each file and split of it.
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = lines.join(F.broadcast(starts), ["file", "_part"]).withColumn("line", F.col("_before") + F.col("_id") - F.col("_first") + 1)
    parsed = F.from_csv("value", F.lit(schema), {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    bad = numbered.where((F.trim("value") != "") & (F.col("line") > 1)).withColumn("_parsed", parsed).where("_parsed._broken is not null")
    return bad.select("file", "line", F.col("value").alias("record"))


def require_whole_lines(spark: SparkSession, path: str, sep: str = ",") -> None:
    """Raises with the place and text of the first lines that have too many or too few fields."""
    bad = broken_lines(spark, path, sep).orderBy("file", "line").limit(5).collect()
    if bad:
        raise ContractError("lines with too many or too few fields: " + "; ".join(f"{r.file}:{r.line}: {r.record}" for r in bad))


def inspect_labels(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame:
    """(split, grade_0..4, n) of a strict label CSV: whole lines, grades as one digit, known splits, unique ids.

    Referral flags, if the file has them, must be there in each row and agree with the grade.
    """
    require_whole_lines(spark, path)
    rows = read_text_table(spark, path)
    flagged = "is_referable" in rows.columns
    require_columns(rows, ["id_code", "diagnosis", "split"])
    flag = {"is_referable": F.lower("is_referable").isin("true", "false") & ((F.lower("is_referable") == "true") == (F.col("diagnosis") >= "2"))} if flagged else {}
    require(rows, {"id_code": is_safe_id("id_code"), "diagnosis": F.col("diagnosis").rlike("^[0-4]$"), "split": F.col("split").isin("train", "valid", "test")} | flag)
    require_unique(rows, "id_code")
    if expected_rows is not None and (n := rows.count()) != expected_rows:
        raise ContractError(f"{expected_rows} rows are expected, not {n}")
    return rows.groupBy("split").agg(*[F.count_if(F.col("diagnosis") == str(g)).alias(f"grade_{g}") for g in range(5)], F.count(F.lit(1)).alias("n"))


def read_paired(spark: SparkSession, path: str, cluster: str | None = None) -> DataFrame:
    """(id_code, diagnosis, baseline_grade, candidate_grade, cluster) of a paired prediction file."""
    grades = ["diagnosis", "baseline_grade", "candidate_grade"]
    rows = read_text_table(spark, path, ["id_code", *grades, *([cluster] if cluster else [])])
    require(rows, {"id_code": is_safe_id("id_code")} | {g: F.col(g).rlike("^[0-4]$") for g in grades} | ({cluster: is_cluster(cluster)} if cluster else {}))
    require_unique(rows, "id_code")
    return rows.withColumns({g: F.col(g).cast("int") for g in grades})


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(left, right) stems of a ``;``-separated pair table; each image in one pair only, never with itself."""
    rows = read_text_table(spark, path, ["left", "right"], sep=";").select(stem(F.trim("left")).alias("left"), stem(F.trim("right")).alias("right"))
    require(rows, {"left": is_safe_id("left"), "right": is_safe_id("right"), "distinct": F.col("left") != F.col("right")})
    require_unique(rows.select(F.explode(F.array("left", "right")).alias("image")), "image")
    return rows


def validate_external(df: DataFrame, grade: str = "diagnosis", key: str = "id_code") -> DataFrame:
    """An external label table as (key, grade INT): padding rows that are blank in both go, anything else broken raises."""
    rows = df.dropna(how="all", subset=[key, grade]).withColumn("_g", F.col(grade).try_cast("double"))
    require(rows, {key: is_safe_id(key), grade: is_grade("_g")})
    require_unique(rows.select(stem(F.col(key)).alias(key)), key)
    return rows.withColumn(grade, F.col("_g").cast("int")).drop("_g")


def load_cohort(spark: SparkSession, path: str, key: str, grade: str, gradable: str | None = None) -> DataFrame:
    """(id_code, diagnosis) from an external file with other names: pruned to its columns, gradable rows only, ids as stems."""
    rows = read_text_table(spark, path, [key, grade, *([gradable] if gradable else [])])
    if gradable:
        rows = rows.where(F.col(gradable).try_cast("double") == 1)
    return validate_external(rows.select(stem(F.trim(key)).alias("id_code"), F.trim(grade).alias("diagnosis")))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON reports, a document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def explode_folds(folds: DataFrame) -> DataFrame:
    """(sweep, fold, pos, id_code, test_true, test_raw) rows from arrays of equal length by fold."""
    zipped = folds.select("sweep", "fold", F.posexplode(F.arrays_zip("test_ids", "test_true", "test_raw")).alias("pos", "x"))
    return zipped.select("sweep", "fold", "pos", F.col("x.test_ids").alias("id_code"), F.col("x.test_true").alias("test_true"), F.col("x.test_raw").alias("test_raw"))


def read_fold_archives(spark: SparkSession, path: str) -> DataFrame:
    """(sweep, fold, pos, id_code, test_true, test_raw) of legacy archives ``<sweep>/fold<k>.npz`` below ``path``, a task for each.

    Where the session lets Python sources take filters (spark.sql.python.filterPushdown.enabled), archives of other sweeps and
    folds than a filter asks for are not opened.
    """
    spark.dataSource.register(FoldArchives)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FOLDS).option("path", path).option("pushdown", pushdown).load()


def read_runs(spark: SparkSession, table: str, fallback: str) -> DataFrame:
    """The run store ``table``, or the exported CSV where there is none."""
    if spark.catalog.tableExists(table):
        return spark.table(table)
    return spark.read.option("header", True).option("inferSchema", True).csv(fallback)


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """(id_code, patient_id) with unique, non-empty ids on the left and real names on the right."""
    rows = read_text_table(spark, path, ["id_code", "patient_id"]).select(F.trim("id_code").alias("id_code"), F.trim("patient_id").alias("patient_id"))
    require(rows, {"id_code": is_safe_id("id_code"), "patient_id": is_cluster("patient_id")})
    require_unique(rows, "id_code")
    return rows


def read_ids(spark: SparkSession, path: str, key: str = "id_code", grade: str = "diagnosis") -> DataFrame:
    """(id_code, diagnosis) of a strict file: unique safe ids, and grades that say 0 to 4 as whole numbers."""
    rows = read_text_table(spark, path, [key, grade]).select(F.trim(key).alias("id_code"), F.trim(grade).alias("diagnosis"))
    require(rows, {"id_code": is_safe_id("id_code"), "diagnosis": is_whole_grade("diagnosis")})
    require_unique(rows, "id_code")
    return rows.withColumn("diagnosis", F.substring("diagnosis", 1, 1).cast("int"))


def find_files(spark: SparkSession, path: str, wanted: DataFrame, pattern: str = "*.png") -> DataFrame:
    """(id_code, path): the file of each of ``wanted`` (id_code); an id with no file or several raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    named = files.select(stem(F.col("path")).alias("id_code"), "path")
    bad = not_exactly_one(named, wanted, "id_code").orderBy("id_code").limit(5).collect()
    if bad:
        raise ContractError(f"not exactly one file: {[tuple(r) for r in bad]}")
    return named.join(wanted.select("id_code").distinct(), "id_code", "left_semi")


def ensemble(rows: DataFrame, folds: int) -> DataFrame:
    """(sweep, id_code, diagnosis, raw, in_order): the mean score over all folds; each id must be in every fold once, with one truth.

    ``in_order`` says whether the id has one place in all folds.
    """
    low_high = [x for c in ("test_true", "pos") for x in (F.min(c).alias(f"_{c}"), F.max(c).alias(f"_{c}_high"))]
    per = rows.groupBy("sweep", "id_code").agg(F.avg("test_raw").alias("raw"), *low_high, F.count(F.lit(1)).alias("_n"), F.count_distinct("fold").alias("_folds"))
    require(per, {"one truth": F.col("_test_true") == F.col("_test_true_high"), "all folds": (F.col("_n") == folds) & (F.col("_folds") == folds)})
    return per.select("sweep", "id_code", F.col("_test_true").alias("diagnosis"), "raw", (F.col("_pos") == F.col("_pos_high")).alias("in_order"))


def graded_ensemble(rows: DataFrame, cuts: DataFrame, folds: int, in_order: bool = False) -> DataFrame:
    """(sweep, id_code, diagnosis, raw, pred): scores and cuts are averaged over the folds, then graded once.

    ``cuts`` (sweep, fold, cuts) has an array for each fold. ``in_order`` asks for one order of ids in all folds.
    """
    require(cuts, {"cuts": valid_cuts(F.col("cuts"))})
    scored = ensemble(rows, folds)
    if in_order:
        require(scored, {"in_order": F.col("in_order")})
    each = cuts.select("sweep", F.posexplode("cuts").alias("k", "c")).groupBy("sweep", "k").agg(F.avg("c").alias("c"))
    mean = each.groupBy("sweep").agg(F.array_sort(F.collect_list("c")).alias("_cuts"))
    # A row for each sweep.
    graded = scored.join(F.broadcast(mean), "sweep").withColumn("pred", F.size(F.filter("_cuts", lambda c: c <= F.col("raw"))))
    return graded.select("sweep", "id_code", "diagnosis", "raw", "pred")
