"""URL rules by a sort-merge range join.

A url's key is its host with the labels reversed, each closed by a comma, and its path: ``com,example,www,/en/a``. All urls on
a rule's host or below stand in one interval of keys, those that start with the rule's reversed host, and such intervals nest.
Keys are cut into ranges; a rule goes to each range that its interval meets. Each range is sorted and swept once, with a
stack of the hosts whose rules are active; the longest active rule whose path starts the url's path wins. Urls with one key
are told apart by a hash of their page, so that ranges cut through them as well. Pages without a host meet no rule and skip
the sweep.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "allow"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
JUDGED = "page_id long, host string, path string, rule string, verdict string"
#: Ranges of keys for each partition, and sampled keys of each range from which its bounds are taken.
RANGES, SAMPLED = 4, 16
#: Above every key that starts with the same reversed host.
_AFTER = "\U0010ffff"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",")))


def _bounds(keys: DataFrame, ranges: int) -> list[tuple[bytes, int]]:
    """Ascending (key, place) that cut the pages about evenly: quantiles of a sample drawn by hash.

    About SAMPLED * ``ranges`` rows come to the driver, however many there are; rows equal in key and page come once.
    """
    wanted, total = SAMPLED * ranges, keys.count()
    drawn = keys.where(F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < min(1.0, wanted / max(total, 1)) * (1 << 30))
    sample = sorted((r.key.encode(), r.place) for r in drawn.select("key", "place").distinct().toLocalIterator())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url) under ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains where the url's path starts with the rule's. The longest fitting rule wins
    (host and path together; then the longer host; of equal rules ``block``). A null url, or one without ``://``, has an
    empty host and path. Where no rule fits, the verdict is ``default``. Rules with a null or empty host, a null path or a
    null verdict fit nothing. Repeated pages give repeated rows; long urls are matched whole; an empty table of either kind is
    no error.
    """
    spark = pages.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col("url")
    every = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosted = every.where("host <> ''").withColumn("key", F.concat(reversed_host(F.col("host")), "path"))
    keys = hosted.withColumn("place", F.xxhash64("key", "page_id"))
    bounds = _bounds(keys, RANGES * partitions)
    shared = spark.sparkContext.broadcast(bounds)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(shared.value, (k.encode(), p)) for k, p in zip(batch.column("key").to_pylist(), batch.column("place").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns[:-1]], names=["part", *batch.schema.names[:-1]])

    placed = keys.select("key", "page_id", "host", "path", "place").mapInArrow(parts, "part int, key string, page_id long, host string, path string")
    named = rules.where("host <> '' and path is not null and verdict is not null").select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").distinct()
    spans = named.withColumn("key", reversed_host(F.col("host"))).select("key", "host", "path", "verdict").mapInArrow(_spread(shared), SPANS)
    spans = spans.withColumn("part", F.explode(F.sequence("first", "last"))).select(
        "part", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict"
    )
    events = spans.unionByName(placed.select("part", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")))
    in_order = events.repartition(partitions, "part").sortWithinPartitions("part", "key", "kind", "path", "verdict")
    hostless = every.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict[str, tuple[str, str]]]] = []
        part = None
        for batch in batches:
            out = []
            for at, key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    stack, part = [], at
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}))
                    stack[-1][1][path] = (f"{host}{path}", max(verdict, stack[-1][1].get(path, ("", ""))[1]))
                else:
                    out.append((page, host, path, *_longest(stack, path)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    def _longest(stack: list, path: str) -> tuple[str | None, str]:
        best = None
        for _, paths in reversed(stack):
            fits = next((p for p in _prefixes(path, paths) if p in paths), None)
            if fits is not None and (best is None or len(paths[fits][0]) > len(best[0])):
                best = paths[fits]
        return best or (None, default)

    return in_order.mapInArrow(sweep, JUDGED).unionByName(hostless)


SPANS = "first int, last int, key string, host string, path string, verdict string"


def _spread(shared):
    """The ranges of keys that each rule's interval meets, by the broadcast bounds."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [key for key, _ in shared.value]
        for batch in batches:
            keys = batch.column("key").to_pylist()
            first, last = [bisect_left(starts, k.encode()) for k in keys], [bisect_right(starts, (k + _AFTER).encode()) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32()), *batch.columns], names=["first", "last", *batch.schema.names])

    return spread


def _prefixes(path: str, paths: dict) -> Iterator[str]:
    """What could be a rule's path, longest first: the prefixes of ``path``, or the rules' own if they are fewer."""
    if len(paths) < len(path):
        yield from sorted((p for p in paths if path.startswith(p)), key=len, reverse=True)
    else:
        yield from (path[:n] for n in range(len(path), -1, -1))


_NAMES = [c.split()[0] for c in JUDGED.split(", ")]
_TYPES = [pa.int64()] + [pa.string()] * 4


def production_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")
