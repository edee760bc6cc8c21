"""Folders of derived images that record how they were made: settings and counts, held against what is asked for and what is there."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators.checks import ContractError
from gradus.operators.nested import compare_settings

# The record's name, its settings and its count, which is a result and no setting.
MANIFEST = "_manifest.json"
SETTINGS = ("size", "clahe", "clip_limit", "square_mode")
COUNT = "n_images"


def _text(value: object) -> str:
    """A value as JSON; 512.0 reads as 512."""
    return json.dumps(int(value) if isinstance(value, float) and value.is_integer() else value, sort_keys=True)


def write_manifest(path: str, settings: dict, images: int) -> None:
    """Records at the cache folder ``path`` those of ``settings`` that define a cache, and how many images it has."""
    store, folder = pafs.FileSystem.from_uri(path)
    store.create_dir(folder)
    record = {k: settings[k] for k in SETTINGS if k in settings} | {COUNT: int(images)}
    with store.open_output_stream(f"{folder}/{MANIFEST}") as stream:
        stream.write((json.dumps(record, indent=2, allow_nan=False) + "\n").encode())


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(cache, state, settings) of each folder in ``path``: settings as a map of JSON texts, null unless the state is ``read``.

    The state is ``unrecorded`` where a folder has no record, ``unreadable`` where that is no JSON object. The driver lists the
    folders, one entry a cache; tasks open their records.
    """
    store, root = pafs.FileSystem.from_uri(path)
    caches = sorted((f.base_name,) for f in store.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for cache in frame["cache"]:
                try:
                    with pafs.FileSystem.from_uri(path)[0].open_input_stream(f"{root}/{cache}/{MANIFEST}") as stream:
                        found = json.loads(stream.read())
                except FileNotFoundError:
                    out.append((cache, "unrecorded", None))
                    continue
                except ValueError:
                    found = None
                good = isinstance(found, dict)
                out.append((cache, "read" if good else "unreadable", {k: _text(v) for k, v in found.items()} if good else None))
            yield pd.DataFrame(out, columns=["cache", "state", "settings"])

    return spark.createDataFrame(caches, "cache string").mapInPandas(read, "cache string, state string, settings map<string,string>")


def image_counts(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(cache, images): how many files of ``pattern`` lie at any depth in each folder of ``path``, from the listing alone; no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    depth = len([s for s in urlsplit(path).path.split("/") if s])
    parts = F.split(F.parse_url(F.col("_metadata.file_path"), F.lit("PATH")), "/")
    # Parts begin with an empty one; a file that lies in ``path`` itself is in no cache.
    inside = files.select(parts.alias("parts")).where(F.size("parts") > depth + 2)
    cache = F.url_decode(F.replace(F.element_at("parts", depth + 2), F.lit("+"), F.lit("%2B")))
    return inside.groupBy(cache.alias("cache")).agg(F.count(F.lit(1)).alias("images"))


def cache_findings(spark: SparkSession, path: str, expected: dict, pattern: str = "*.jpg") -> DataFrame:
    """(cache, setting, recorded, wanted, problem) for each way in which a cache in ``path`` is not what ``expected`` asks for.

    ``differs``: a setting that ``expected`` names, others are free; one that is not recorded counts as null. ``count``: as many
    images were recorded as are not there, or more are, as after an interrupted run; none recorded is no finding. A folder whose
    record is missing or broken has one row, ``unrecorded`` or ``unreadable``. Values are JSON texts.
    """
    manifests = read_manifests(spark, path)
    null = F.lit(None).cast("string")
    names = [n for n in SETTINGS if n in expected]
    found = manifests.where("state = 'read'")
    out = manifests.where("state <> 'read'").select("cache", null.alias("setting"), null.alias("recorded"), null.alias("wanted"), F.col("state").alias("problem"))
    if names:
        recorded = F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.col("settings")[n], F.lit("null")))])
        wanted = F.create_map(*[F.lit(x) for n in names for x in (n, _text(expected[n]))])
        differ = compare_settings(found.select("cache", recorded.alias("l"), wanted.alias("r")), "cache", "l", "r")
        out = out.unionByName(differ.select("cache", "setting", F.col("left").alias("recorded"), F.col("right").alias("wanted"), "problem"))
    there = F.coalesce("images", F.lit(0)).cast("string")
    counted = found.select("cache", F.col("settings")[COUNT].alias("recorded")).where("recorded <> 'null'").join(image_counts(spark, path, pattern), "cache", "left")
    off = counted.select("cache", F.lit(COUNT).alias("setting"), "recorded", there.alias("wanted"), F.lit("count").alias("problem"))
    return out.unionByName(off.where("recorded <> wanted"))


def require_caches(spark: SparkSession, path: str, expected: dict, pattern: str = "*.jpg") -> None:
    """Raises with the first findings, if there are any."""
    bad = cache_findings(spark, path, expected, pattern).orderBy("cache", "setting").limit(5).collect()
    if bad:
        raise ContractError(f"{path} is not as asked for: " + "; ".join(f"{r.cache}: {r.setting or 'record'} {r.problem}, {r.recorded} for {r.wanted}" for r in bad))


def describe(settings: Column) -> Column:
    """A line for a run's log from a map of recorded settings."""
    said = lambda name: F.coalesce(F.btrim(settings[name], F.lit('"')), F.lit("?"))
    clahe = F.when(settings["clahe"] == "true", F.concat(F.lit("CLAHE clip="), said("clip_limit"))).otherwise("no CLAHE")
    return F.concat(said("size"), F.lit("px, "), clahe, F.lit(", square="), said("square_mode"), F.lit(", n="), said(COUNT))
