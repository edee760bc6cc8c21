"""Comparison of nested reports, and of two runs' settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.operators.audits import ABSOLUTE, RELATIVE

#: What a JSON value is, by the first word of its VARIANT type.
_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _kind(value: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    known = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.when(F.is_variant_null(value), "null").otherwise(F.coalesce(known[name], F.lit("number")))


def json_nodes(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, kind, number, text) of every value in the JSON texts ``document``, containers included.

    Texts are parsed once into VARIANT and opened level by level, all documents together; the loop ends with the deepest one.
    Paths read ``$.a.b[0]``; a name with other characters than letters, digits and ``_`` stands in quotes. An array's number
    is its length. A null document has no node; a text that is no JSON raises.
    """
    spark = df.sparkSession
    level = df.where(F.col(document).isNotNull()).select(key, F.lit("$").alias("path"), F.parse_json(document).alias("v"))
    found = None
    while True:
        nodes = level.withColumn("kind", _kind(F.col("v")))
        number = F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double")).when(F.col("kind") == "array", F.size(F.try_variant_get("v", "$", "array<variant>")).cast("double"))
        text = F.when(F.col("kind").isin("string", "boolean"), F.try_variant_get("v", "$", "string"))
        rows = nodes.select(key, "path", "kind", number.alias("number"), text.alias("text"))
        found = rows if found is None else found.unionByName(rows)
        inner = nodes.where(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            return found
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        name = F.when(F.col("_key").rlike(r"^\w+$"), F.col("_key")).otherwise(F.concat(F.lit('"'), F.col("_key"), F.lit('"')))
        step = F.when(F.col("kind") == "array", F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), name))
        level = below.select(key, F.concat("path", step).alias("path"), F.col("_value").alias("v"))


def compare_reports(recorded: DataFrame, found: DataFrame, key: str, document: str, relative: float = RELATIVE, absolute: float = ABSOLUTE) -> DataFrame:
    """(key, path, change, recorded, found, recorded_text, found_text): every place at which two versions of a report differ.

    ``change`` is missing (only recorded), added, kind, length (of arrays), number (beyond the tolerances) or text. Values
    below a changed length that both have are compared too. Reports that only one side has differ at every path.
    """
    a, b = (json_nodes(df, key, document).select(key, "path", *[F.col(c).alias(f"{side}_{c}") for c in ("kind", "number", "text")]) for df, side in ((recorded, "a"), (found, "b")))
    both = a.join(b, [key, "path"], "full_outer")
    apart = F.abs(F.col("a_number") - F.col("b_number")) > absolute + relative * F.abs(F.col("b_number"))
    change = (
        F.when(F.col("b_kind").isNull(), "missing").when(F.col("a_kind").isNull(), "added").when(F.col("a_kind") != F.col("b_kind"), "kind")
        .when((F.col("a_kind") == "array") & (F.col("a_number") != F.col("b_number")), "length")
        .when((F.col("a_kind") == "number") & apart, "number").when(F.col("a_text") != F.col("b_text"), "text")
    )
    return both.select(
        key, "path", change.alias("change"), F.col("a_number").alias("recorded"), F.col("b_number").alias("found"), F.col("a_text").alias("recorded_text"), F.col("b_text").alias("found_text")
    ).where("change is not null")


def compare_settings(df: DataFrame, key: str, left: str, right: str, ignored: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """(key, setting, left, right, problem) for each setting that breaks the contract of two runs' settings, maps of text.

    A setting must be on both sides and equal (``differs``, ``only_left``, ``only_right``), unless its name begins with one of
    ``ignored``; one of ``required`` must be there at all (``absent``). A null map is empty; a null value equals a null only.
    """
    empty = F.create_map().cast("map<string,string>")
    seen = lambda c: F.transform_values(F.coalesce(c, empty), lambda _, v: F.struct(v.alias("value")))
    maps = df.select(key, seen(F.col(left)).alias("_l"), seen(F.col(right)).alias("_r"))

    def verdict(name: Column, a: Column, b: Column) -> Column:
        skip = F.lit(False)
        for prefix in ignored:
            skip = skip | name.startswith(prefix)
        problem = F.when(a.isNull(), "only_right").when(b.isNull(), "only_left").when(~a["value"].eqNullSafe(b["value"]), "differs")
        return F.struct(a["value"].alias("left"), b["value"].alias("right"), F.when(~skip, problem).alias("problem"))

    zipped = maps.select(key, F.explode(F.map_zip_with("_l", "_r", verdict)).alias("setting", "x")).select(key, "setting", "x.*").where("problem is not null")
    text = F.lit(None).cast("string")
    wanted = F.array(*[F.lit(n) for n in required]).cast("array<string>")
    absent = maps.select(key, F.explode(F.array_except(wanted, F.array_union(F.map_keys("_l"), F.map_keys("_r")))).alias("setting"))
    return zipped.unionByName(absent.select(key, "setting", text.alias("left"), text.alias("right"), F.lit("absent").alias("problem")))
