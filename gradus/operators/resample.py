"""Cluster bootstraps from additive statistics: rows are summed per cluster once, and draws only weigh those sums.

Slot s of draw d takes the cluster whose place in sorted order is the md5 hash of ``d:s`` modulo the number of clusters; or the
draws are those of NumPy's generator, for limits that equal published ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegralType, StructField, StructType

from gradus.functions.scalars import hash32, ratio
from gradus.operators.ranges import RANGE, bounds, placed


def numbered(clusters: DataFrame, key: str) -> DataFrame:
    """Adds ``place`` from 0 in order of ``key``, and ``clusters``, their number: one row a cluster.

    Places come from counts of key ranges: each partition numbers its own rows after those before it. Rows are cut, numbered
    within their partition and kept once, so the sums are not computed again; the driver holds one number for each partition.
    """
    ranged = clusters.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()).localCheckpoint()
    # Ids have the partition above 33 bits of the row's number there.
    part, local = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = dict(map(tuple, ranged.groupBy(part).count().collect()))
    starts = list(accumulate((sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)), initial=0))
    before = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), part)
    return ranged.select("*", F.lit(starts[-1]).cast("long").alias("clusters"), (before + local).alias("place")).drop("_id")


def slots(clusters: DataFrame, n: int) -> DataFrame:
    """(draw, place): the cluster in each slot of ``n`` draws, each of as many slots as ``clusters`` has rows."""
    every = clusters.select("clusters", F.col("place").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    hit = F.pmod(hash32(F.concat_ws(":", F.col("draw").cast("string"), F.col("slot").cast("string"))), F.col("clusters"))
    return every.select("draw", hit.alias("place"))


def draws(clusters: DataFrame, n: int) -> DataFrame:
    """(draw, place, times) of ``n`` draws."""
    return slots(clusters, n).groupBy("draw", "place").agg(F.count(F.lit(1)).alias("times"))


#: Clusters of a block of places, and places that are hashed at once.
BLOCK, HASHED = 1 << 12, 50_000


def packed_slots(spark: SparkSession, clusters: int, n: int, shared: bool = False) -> DataFrame:
    """(draw, block, times): the draws of ``slots``, a byte for each place of a block: how often its cluster is drawn.

    A row holds counts up to 255; what is beyond has further rows of the same draw and block. With ``shared``, two places have
    a byte, one of the block's first half in its lower bits and one of the second half above, with counts up to 15, and zeros
    fill up the last block.
    """

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = np.empty(clusters, np.intp)
        for frame in frames:
            for draw in map(int, frame["id"]):
                for a, b in _alike(clusters):
                    hits[a:b] = np.remainder(md5_heads(f"{draw}:", a, b), np.uint32(clusters))
                yield from _packed(draw, hits, clusters, BLOCK, shared)

    tasks = min(n, 8 * spark.sparkContext.defaultParallelism)
    return spark.range(0, n if clusters else 0, 1, tasks).mapInPandas(drawn, "draw int, block long, times binary")


def _alike(end: int) -> Iterator[tuple[int, int]]:
    """Runs of the numbers below ``end`` that differ in their last ``LOW`` digits only."""
    a = 0
    while a < end:
        b = min(end, a + HASHED, (a // 10**LOW + 1) * 10**LOW)
        yield a, b
        a = b


def _packed(draw: int, hits: np.ndarray, clusters: int, wide: int = BLOCK, shared: bool = False) -> Iterator[pd.DataFrame]:
    most, out = 15 if shared else 255, []
    counts = np.zeros(clusters, np.uint8)
    np.add.at(counts, hits, np.uint8(1))
    if counts.sum(dtype=np.int64) < len(hits):
        # A byte has run over.
        counts = np.bincount(hits, minlength=clusters)
    blocks = -(-clusters // wide)
    left = range(blocks)
    while left:
        times = np.minimum(counts, most).astype(np.uint8)
        if shared:
            halves = np.pad(times, (0, blocks * wide - clusters)).reshape(blocks, 2, wide // 2)
            both = halves[:, 0] | halves[:, 1] << 4
            out += [(draw, block, both[block].tobytes()) for block in left]
        else:
            out += [(draw, block, times[block * wide : (block + 1) * wide].tobytes()) for block in left]
        left = []
        if counts.max() > most:
            counts = counts - times
            left = np.unique(np.flatnonzero(counts) // wide).tolist()
    yield pd.DataFrame(out, columns=["draw", "block", "times"])


#: Digits at a number's end that are looked up as words of md5's block.
LOW = 5


@cache
def _endings(shift: int, leading: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words of md5's block with the numbers below 10**LOW after ``shift`` bytes and the bit behind them, and each number's digits.

    ``leading``: further digits go before them, so zeros lead up to ``LOW`` digits.
    """
    numbers = np.arange(10**LOW)
    digits = np.full(len(numbers), LOW) if leading else sum((numbers >= 10**i for i in range(1, LOW)), np.ones(len(numbers), int))
    text = np.zeros((len(numbers), 4 * ((shift + LOW) // 4 + 1)), np.uint8)
    for i in range(LOW):
        has = np.flatnonzero(digits > i)
        text[has, shift + digits[has] - 1 - i] = has // 10**i % 10 + 48
    text[numbers, shift + digits] = 0x80
    return np.ascontiguousarray(text.view("<u4").T), digits


def md5_heads(prefix: str, first: int, end: int) -> np.ndarray:
    """The first 32 bits of the md5 of ``prefix`` and each number from ``first`` to below ``end``, which differ in their last ``LOW`` digits only.

    All are hashed side by side, as one block of at most 55 bytes each; a hash library would be called once for each.
    Steps before the first word that differs are done once for all, and the last three, which don't reach these bits, not at all.
    """
    high, low = divmod(first, 10**LOW)
    head, u = f"{prefix}{high or ''}".encode(), np.uint32
    if len(head) + LOW > 55 or (end - 1) // 10**LOW != high:
        raise ValueError("one block, and numbers that differ in their last digits only")
    at, shift = divmod(len(head), 4)
    tails, digits = _endings(shift, high > 0)
    mine = slice(low, low + end - first)
    fixed = np.frombuffer(head.ljust(64, b"\0"), "<u4").tolist()
    words = {at + i: tail[mine] for i, tail in enumerate(tails)}
    if high:
        fixed[14] = 8 * (len(head) + LOW)
    else:
        words[14] = (8 * (len(head) + digits[mine])).astype(u)
    a, b, c, d = _START
    for i in range(at):
        f = (a + (d ^ b & (c ^ d)) + fixed[i] + _SINES[i]) & 0xFFFFFFFF
        turn = _TURNS[0][i % 4]
        a, d, c, b = d, c, b, (b + (f << turn | f >> 32 - turn)) & 0xFFFFFFFF
    room = _room()[:, : end - first]
    room[:4] = np.array([[a], [b], [c], [d]], u)
    a, b, c, d, f, kept = room
    added = np.array([(x + fixed[k]) & 0xFFFFFFFF for x, k in zip(_SINES, _WORDS, strict=False)], u)
    for i in range(at, 61):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i >= 48:
            np.bitwise_not(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        elif i % 2 == 0:
            np.bitwise_xor(b, c, kept)
            np.bitwise_xor(kept, d, f)
        else:
            # c and d are b and c of the step before.
            np.bitwise_xor(b, kept, f)
        np.add(f, a, f)
        if _WORDS[i] in words:
            np.add(f, words[_WORDS[i]], f)
        np.add(f, added[i], f)
        left, right = _TURNED[i // 16][i % 4]
        np.right_shift(f, right, a)
        np.left_shift(f, left, f)
        np.bitwise_or(f, a, f)
        np.add(f, b, f)
        a, f, d, c, b = d, a, c, b, f
    # Three more steps would move b to the first place.
    return (b + u(_START[0])).byteswap()


@cache
def _room() -> np.ndarray:
    """What ``md5_heads`` computes in, kept from call to call."""
    return np.empty((6, 10**LOW), np.uint32)


#: Fixed values of md5, and some as arrays without dimensions, which NumPy takes faster than numbers.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: The word of the block that a step adds.
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_TURNED = [[(np.array(t, np.uint32), np.array(32 - t, np.uint32)) for t in turns] for turns in _TURNS]


def resampled(clusters: DataFrame, sums: Sequence[str], n: int) -> DataFrame:
    """(draw, sums): the sums of each draw's clusters. ``clusters`` has place, clusters and the additive columns ``sums``."""
    size = clusters.count()
    return weighed(clusters, sums, packed_slots(clusters.sparkSession, size, n, shared=True), size)


#: Blocks that a task weighs, about: their counts of all draws are sorted together.
BLOCKS = 8


def weighed(clusters: DataFrame, sums: Sequence[str], packed: DataFrame, size: int) -> DataFrame:
    """(draw, sums) of draws packed with ``shared``: a block of the ``size`` clusters meets its counts of all draws, and only a row for each draw leaves it."""
    blocks = -(-size // BLOCK) or 1
    tasks = min(blocks, max(clusters.sparkSession.sparkContext.defaultParallelism, blocks // BLOCKS))
    whole = {f.name: isinstance(f.dataType, IntegralType) for f in clusters.select(*sums).schema}
    mine = clusters.select(F.floor(F.col("place") / BLOCK).alias("block"), (F.col("place") % BLOCK).alias("at"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])

    def weigh(rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        half = BLOCK // 2
        times = np.frombuffer(b"".join(drawn["times"]), np.uint8).reshape(len(drawn), half)
        table = np.zeros((BLOCK, len(sums)))
        table[rows["at"]] = rows[list(sums)]
        out = np.empty((len(times), len(sums)))
        for i in range(0, len(times), 256):
            halves = times[i : i + 256] & 15, times[i : i + 256] >> 4
            # Whole numbers below 2^24 are added exactly in single precision.
            small = all(whole.values()) and np.abs(table).max() * sum(h.sum(axis=1, dtype=np.int64) for h in halves).max() < 1 << 24
            kind = np.float32 if small else np.float64
            out[i : i + 256] = sum(h.astype(kind) @ t.astype(kind) for h, t in zip(halves, (table[:half], table[half:]), strict=True))
        return pd.DataFrame({"draw": drawn["draw"]} | {c: np.rint(out[:, i]).astype(np.int64) if whole[c] else out[:, i] for i, c in enumerate(sums)})

    schema = "draw int, " + ", ".join(f"`{c}` {'long' if whole[c] else 'double'}" for c in sums)
    met = mine.repartition(tasks, "block").groupBy("block").cogroup(packed.repartition(tasks, "block").groupBy("block"))
    return met.applyInPandas(weigh, schema).groupBy("draw").agg(*[F.sum(c).alias(c) for c in sums])


#: Numbers that are drawn at a time.
CHUNK = 1 << 18


def generator_draws(spark: SparkSession, clusters: int, n: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(draw, place, times) of ``n`` draws of ``clusters`` slots, as NumPy's default generator of ``seed`` makes them one after another.

    A stream can't be entered in its middle, so the driver walks through it once, ``chunk`` numbers at a time, and keeps the
    generator's state before each draw; tasks make the draws again from there. A place may have several rows in a draw, of
    which ``times`` are added up. The walk takes a few seconds for each 10^9 numbers: beyond some 10^7 clusters use ``slots``.
    """

    def counted(draw: int, parts: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        for part in parts:
            places, times = np.unique(part, return_counts=True)
            yield pd.DataFrame({"draw": draw, "place": places, "times": times})

    return _generated(spark, clusters, n, seed, chunk, counted, "draw int, place long, times long")


def packed_generator_draws(spark: SparkSession, clusters: int, n: int, seed: int, chunk: int = CHUNK, shared: bool = False) -> DataFrame:
    """The same draws as ``packed_slots`` has them."""

    def packed(draw: int, parts: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        return _packed(draw, np.concatenate(list(parts)), clusters, BLOCK, shared)

    return _generated(spark, clusters, n, seed, chunk, packed, "draw int, block long, times binary")


def _generated(spark: SparkSession, clusters: int, n: int, seed: int, chunk: int, shape: Callable, schema: str) -> DataFrame:
    sizes = [chunk] * (clusters // chunk) + [clusters % chunk]
    generator, states = np.random.default_rng(seed), []
    for draw in range(n if clusters else 0):
        states.append((draw, json.dumps(generator.bit_generator.state)))
        for size in sizes:
            generator.integers(0, clusters, size=size)

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.random.default_rng()
        for frame in frames:
            for draw, state in zip(frame["draw"], frame["state"], strict=True):
                mine.bit_generator.state = json.loads(state)
                yield from shape(draw, (mine.integers(0, clusters, size=size) for size in sizes))

    return spark.createDataFrame(states, "draw int, state string").mapInPandas(again, schema)


def resampled_by(clusters: DataFrame, sums: Sequence[str], drawn: DataFrame) -> DataFrame:
    """(draw, sums): as ``resampled``, for the draws (draw, place, times) that are given."""
    return drawn.join(clusters.select("place", *sums), "place").groupBy("draw").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in sums])


def paired_rates(sums: DataFrame) -> DataFrame:
    """(draw, sensitivity, specificity, referral): how far two arms' rates are apart in each draw.

    ``sums`` has a draw's ill and healthy rows (pos, neg) and of those the ones each arm gets right (ta, tb, na, nb). A draw
    without both classes counts for none of the three rates.
    """
    c, both = F.col, (F.col("pos") > 0) & (F.col("neg") > 0)
    apart = {"sensitivity": (c("tb") - c("ta"), c("pos")), "specificity": (c("nb") - c("na"), c("neg")), "referral": (c("tb") - c("ta") + c("na") - c("nb"), c("pos") + c("neg"))}
    return sums.select("draw", *[F.when(both, ratio(k, n)).alias(name) for name, (k, n) in apart.items()])


def interval(values: DataFrame, columns: Sequence[str], n: int, least_valid: float = 0.8) -> DataFrame:
    """(metric, valid, low, high): 95 % percentile limits over the draws in which a metric is defined.

    Limits are null where fewer than ``least_valid`` of the ``n`` draws are valid.
    """
    long = values.select("draw", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])).alias("m")).select("m.metric", "m.value")
    out = long.groupBy("metric").agg(F.count("value").alias("valid"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))
    enough = F.col("valid") >= least_valid * n
    return out.select("metric", "valid", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


#: Scores of one arm's range that a task weighs at once, and bytes of counts by score and draw that a task holds.
WEIGHED, HELD = 256, 256 << 20


def resampled_auc(df: DataFrame, cluster: str, y: Column, score: str, arm: str, n: int) -> DataFrame:
    """(arm, draw, auc) of ``n`` cluster draws; null for a draw without both classes. Scores that are null or NaN are one, the highest.

    A task walks blocks of clusters, each with its rows and its counts of all draws, and adds up how often a score is drawn, so
    that a row for each score, class and task leaves it, however many rows have the score. Scores are then cut into ranges: a range
    adds up its wins for all draws together, and counts the negatives of the ranges below it.
    """
    spark = df.sparkSession
    points = F.coalesce(F.col(score).cast("double"), F.lit(float("nan"))).alias("score")
    counts = df.groupBy(arm, cluster, points).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")).where("pos + neg > 0")
    clusters = numbered(df.select(cluster).distinct(), cluster)
    size, tasks = clusters.count(), spark.sparkContext.defaultParallelism
    rows = counts.join(clusters.select(cluster, "place"), cluster).select(
        F.floor(F.col("place") / BLOCK).alias("block"), F.lit(-1).alias("draw"), F.lit(None).cast("binary").alias("times"), (F.col("place") % BLOCK).cast("int").alias("at"), arm, "score", "pos", "neg"
    )
    packed = packed_slots(spark, size, n).select("block", "draw", "times", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("at", arm, "score", "pos", "neg")])
    # A task has a run of blocks, each with its rows first.
    blocks = -(-size // BLOCK) or 1
    run = F.floor(F.col("block") * min(tasks, blocks) / blocks).cast("int")
    walked = rows.unionByName(packed).repartitionById(min(tasks, blocks), run).sortWithinPartitions("block", "draw")
    loads = StructType([df.schema[arm], StructField("score", DoubleType()), StructField("ill", BooleanType()), StructField("load", BinaryType())])
    # Pandas hands NaN back as null.
    drawn = walked.mapInPandas(lambda frames: _loads(frames, arm, n, HELD), loads).withColumn("score", F.coalesce("score", F.lit(float("nan"))))
    seen = df.select(arm, points).distinct().groupBy(arm, "score").agg(F.lit(1).alias("one")).localCheckpoint()
    ends = bounds(seen, "score", -(-seen.count() // WEIGHED))
    key = [F.col(arm), F.col(RANGE)]
    sums = StructType([df.schema[arm], StructField(RANGE, DoubleType()), *[StructField(c, ArrayType(DoubleType())) for c in ("wins", "pos", "neg")]])

    def weigh(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        places, at = np.unique(frame["score"].to_numpy(), return_inverse=True)
        pos, neg = np.zeros((2, len(places), n))
        for i, ill, load in zip(at, frame["ill"], frame["load"], strict=True):
            (pos if ill else neg)[i] += np.frombuffer(load, "<u4")
        wins = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
        return pd.DataFrame([(*group, wins, pos.sum(axis=0), neg.sum(axis=0))], columns=sums.names)

    parts = placed(drawn, "score", ends).groupBy(*key).applyInPandas(weigh, sums)
    each = parts.select(*key, F.posexplode(F.arrays_zip("wins", "pos", "neg")).alias("draw", "x")).select(*key, "draw", "x.*")
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy(arm, "draw").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = each.withColumn("wins", F.col("wins") + F.col("pos") * lower)
    return won.groupBy(arm, "draw").agg(ratio(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("auc"))


def _loads(frames: Iterator[pd.DataFrame], arm: str, n: int, most_held: int) -> Iterator[pd.DataFrame]:
    """(arm, score, ill, load): 32-bit counts of each of ``n`` draws by score and class, from blocks of rows and their packed draws."""
    at: dict[tuple, int] = {}
    held = np.zeros((64, n), np.uint32)
    for rows, times in _met(frames, n):
        arms, names = pd.factorize(rows[arm], use_na_sentinel=False)
        # An entry for each row that counts, twice where it counts twice.
        entries = np.concatenate([np.repeat(np.arange(len(rows)), rows[c].to_numpy(np.int64)) for c in ("pos", "neg")])
        ill = np.arange(len(entries)) < rows["pos"].sum()
        scores, places, arms = (x[entries] for x in (rows["score"].to_numpy(float), rows["at"].to_numpy(np.int64), arms))
        _, scored = np.unique(scores, return_inverse=True)
        order = np.lexsort((ill, scored, arms))
        new = np.any([x[order][1:] != x[order][:-1] for x in (ill, scored, arms)], axis=0)
        starts = [0, *(np.flatnonzero(new) + 1), len(order)]
        most = max(int(times.max()), 1)
        for a, b in zip(starts, starts[1:], strict=False):
            first = order[a]
            key = (names[arms[first]], None if np.isnan(scores[first]) else scores[first], ill[first])
            i = at.get(key)
            if i is None:
                if len(at) == max(most_held // (4 * n), 1):
                    yield from _let_go(at, held, arm)
                    at.clear()
                    held[:] = 0
                i = at[key] = len(at)
                if i == len(held):
                    held = np.concatenate([held, np.zeros_like(held)])
            found = times[places[order[a:b]]]
            held[i] += found[0] if b - a == 1 else found.sum(axis=0, dtype=np.uint16 if (b - a) * most < 1 << 16 else np.uint32)
    yield from _let_go(at, held, arm)


def _let_go(at: dict[tuple, int], held: np.ndarray, arm: str) -> Iterator[pd.DataFrame]:
    keys = list(at)
    for i in range(0, len(keys), 1024):
        some = keys[i : i + 1024]
        loads = [held[k].astype("<u4").tobytes() for k in range(i, i + len(some))]
        yield pd.DataFrame({arm: [k[0] for k in some], "score": [float("nan") if k[1] is None else k[1] for k in some], "ill": [bool(k[2]) for k in some], "load": loads})


def _met(frames: Iterator[pd.DataFrame], n: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of each block with a 16-bit table of its places by draws; a block comes in one piece after another, rows first."""
    rows: list[pd.DataFrame] = []
    drawn: list[tuple[int, bytes]] = []
    current = None

    def table() -> np.ndarray:
        out = np.zeros((len(drawn[0][1]), n), np.uint16)
        for i in range(0, len(drawn), 64):
            some = drawn[i : i + 64]
            part = np.frombuffer(b"".join(t for _, t in some), np.uint8).reshape(len(some), -1)
            np.add.at(out.T, [d for d, _ in some], part)
        return out

    for frame in frames:
        for block, piece in frame.groupby("block"):
            if block != current:
                if rows and drawn:
                    yield pd.concat(rows), table()
                rows, drawn, current = [], [], block
            mine = piece["draw"] < 0
            if mine.any():
                rows.append(piece[mine].drop(columns=["times"]))
            drawn += zip(piece.loc[~mine, "draw"], piece.loc[~mine, "times"], strict=True)
    if rows and drawn:
        yield pd.concat(rows), table()
