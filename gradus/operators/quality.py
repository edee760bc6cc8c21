"""Data quality: outliers, duplicates, leaks, label noise, summaries of image properties."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gradus.functions.scalars import ratio
from gradus.operators.joins import pairs_within
from gradus.operators.ranges import median

#: Scales the median absolute deviation to a standard deviation.
MAD_SCALE = 0.6745


def mad_outliers(df: DataFrame, value: str, k: float = 3.5) -> DataFrame:
    """Rows whose modified z-score is beyond ``k``, with it; none where the median absolute deviation is 0."""
    # One row each: the median, then the median of the distances to it.
    centre = median(df, value).select(F.col("median").alias("_m"))
    off = df.crossJoin(F.broadcast(centre)).select(F.abs(F.col(value) - F.col("_m")).alias("_off"))
    spread = median(off, "_off").select(F.col("median").alias("_mad")).crossJoin(F.broadcast(centre))
    z = F.lit(MAD_SCALE) * (F.col(value) - F.col("_m")) / F.col("_mad")
    return df.crossJoin(F.broadcast(spread.where("_mad > 0"))).withColumn("z", z).where(F.abs("z") > k).drop("_m", "_mad")


def duplicate_groups(df: DataFrame, content: str, key: str, split: str) -> DataFrame:
    """(content, copies, splits, first_id, crosses): contents of more than one row. A group's rows are counted, not gathered."""
    per = df.groupBy(content, split).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    return per.groupBy(content).agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("splits"), F.min("first").alias("first_id")).where("copies > 1").withColumn("crosses", F.col("splits") > 1)


def leaked_ids(df: DataFrame, content: str, key: str, split: str, train: str, held: Sequence[str]) -> DataFrame:
    """(key): rows of the train split whose content is in a held-out split too."""
    outside = df.where(F.col(split).isin(*held)).select(content).distinct()
    return df.where(F.col(split) == train).join(outside, content, "left_semi").select(key)


def label_noise(df: DataFrame, group: str, key: str, grade: str) -> DataFrame:
    """One row: pairs of rows with the same content, those whose grades conflict, and what that says of a single label."""
    labelled = df.where(F.col(grade).isNotNull() & F.col(group).isNotNull())
    per = pairs_within(labelled, group, key, grade).where("pairs > 0")
    total = per.agg(F.count(F.lit(1)).alias("groups"), F.sum("pairs").alias("pairs"), F.sum("conflicts").alias("conflicts"), F.sum("gap_sum").alias("gap_sum"))
    agree = 1 - ratio(F.col("conflicts"), F.col("pairs"))
    return total.select("groups", "pairs", "conflicts", (1 - agree).alias("rate"), agree.alias("agree"), F.sqrt(agree).alias("single_label_acc"), F.coalesce(ratio(F.col("gap_sum"), F.col("conflicts")), F.lit(0.0)).alias("mean_gap"))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(property, n, low, middle, high, mean) of each numeric column; middle is the exact median."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "property", "v")
    rest = long.groupBy("property").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    return rest.join(median(long, "v", ["property"]), "property", "left").select("property", F.coalesce("n", F.lit(0)).alias("n"), "low", F.col("median").alias("middle"), "high", "mean")


def shares(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` commonest values of ``columns`` with count and share; ties by value."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    top = counts.orderBy(F.desc("n"), *columns).limit(k)
    return top.crossJoin(F.broadcast(whole)).withColumn("share", ratio(F.col("n"), F.col("_all"))).drop("_all")


#: Rows of each side that a task compares at once, about.
TILE = 2048


def similar_pairs(df: DataFrame, block: str, key: str, pixels: str, similarity, least_corr: float, most_mae: float) -> DataFrame:
    """(left, right, corr, mae): verified pairs among rows of an equal blocking hash; copies of one image are compared once.

    Only rows in the same or touching cells are compared, see ``touching``: tiles of a cell's rows with tiles of those around it,
    as products of matrices. ``similarity`` decides about pairs that are at a threshold, up to rounding.
    """
    left, right = (x.withColumn("_width", F.size(c)) for x, c in zip(_sides(df, block, key, pixels, least_corr, most_mae), ("_left", "_right"), strict=True))
    cell = [block, "_a", "_b", "_width"]
    tiles = right.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("_n"))
    id_type = df.schema[key].dataType

    def dealt(rows: DataFrame, name: str, image: str, mine: str, other: str) -> DataFrame:
        placed = rows.join(tiles, cell).withColumns({mine: F.pmod(F.xxhash64(name), "_n"), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))})
        return placed.select(F.struct(*cell, "_s", "_t").alias("_tile"), name, image)

    image = ArrayType(DoubleType())
    schema = StructType([StructField("left", id_type), StructField("right", id_type), StructField("corr", DoubleType()), StructField("mae", DoubleType()), StructField("_left", image), StructField("_right", image)])
    slack = 1e-9 * max(1.0, most_mae)

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            x, y = (np.stack(v).astype(float) for v in (a["_left"], b["_right"]))
            ux, uy = _units(x), _units(y).T
            before = b["right"].to_numpy()
            for i in range(0, len(x), 256):
                corr = ux[i : i + 256] @ uy
                at, to = np.nonzero((corr >= least_corr - 1e-9) & (a["left"].to_numpy()[i : i + 256, None] < before))
                for k in range(0, len(at), 8192):
                    p, q = at[k : k + 8192], to[k : k + 8192]
                    mae, c = np.abs(x[i + p] - y[q]).mean(axis=1), corr[p, q]
                    ok = mae <= most_mae + slack
                    found.append((i + p[ok], q[ok], c[ok], mae[ok]))
        p, q, c, mae = map(np.concatenate, zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0))
        edge = (c < least_corr + 1e-9) | (mae > most_mae - slack)
        pair = {"left": a["left"].to_numpy()[p], "right": b["right"].to_numpy()[q], "corr": c, "mae": mae}
        shown = {"_left": [a["_left"].iloc[i] if e else None for i, e in zip(p, edge, strict=True)], "_right": [b["_right"].iloc[i] if e else None for i, e in zip(q, edge, strict=True)]}
        return pd.DataFrame(pair | {name: pd.Series(images, dtype=object) for name, images in shown.items()})

    pairs = dealt(left, "left", "_left", "_s", "_t").groupBy("_tile").cogroup(dealt(right, "right", "_right", "_t", "_s").groupBy("_tile")).applyInPandas(near, schema)
    sure = F.struct("corr", "mae")
    decided = pairs.withColumn("s", F.when(F.col("_left").isNotNull(), similarity(F.col("_left"), F.col("_right"))).otherwise(sure))
    return decided.select("left", "right", "s.corr", "s.mae").where((F.col("corr") >= least_corr) & (F.col("mae") <= most_mae))


def _units(images: np.ndarray) -> np.ndarray:
    """Each centred and of length 1; without contrast it is like none."""
    off = images - images.mean(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return off / np.sqrt((off * off).sum(axis=1, keepdims=True))


def touching(df: DataFrame, block: str, key: str, pixels: str, least_corr: float, most_mae: float) -> DataFrame:
    """(left, right, _left, _right): each pair of different images of a block that may be as similar as asked, once, with their pixels.

    No such pair is lost. The means of two images are no further apart than their mean absolute difference. Centred and of
    length 1 they are sqrt(2 - 2 corr) apart, and so are at most their projections on a direction, here one half of the pixels
    less the other. Means and projections are cut into cells of these widths, so a row meets its own cell and those around it.
    Images without contrast have no correlation and meet none.
    """
    left, right = _sides(df, block, key, pixels, least_corr, most_mae)
    return left.join(right, [block, "_a", "_b"]).where(F.col("left") < F.col("right")).select("left", "right", "_left", "_right")


def _sides(df: DataFrame, block: str, key: str, pixels: str, least_corr: float, most_mae: float) -> tuple[DataFrame, DataFrame]:
    """Rows in their own cell, and in it and those around it."""
    distinct = df.groupBy(block, pixels).agg(F.min(key).alias(key))
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(pixels)
    placed = distinct.withColumn("_mean", mean)
    total = lambda f: F.aggregate(F.transform(F.col(pixels), f), F.lit(0.0), lambda a, x: a + x)
    off = lambda x: x.cast("double") - F.col("_mean")
    length = F.sqrt(total(lambda x: off(x) * off(x)) * F.size(pixels))
    halves = total(lambda x, i: F.when(2 * i < F.size(pixels), off(x)).otherwise(-off(x)))
    # A little wider than need be, for sums that are rounded.
    wide = lambda width: max(width, 1e-6) * (1 + 1e-6)
    cells = {"_a": F.floor(F.col("_mean") / wide(most_mae)), "_b": F.floor(F.try_divide(halves, length) / wide(max(2 - 2 * least_corr, 0) ** 0.5))}
    placed = placed.withColumns(cells).where("_a is not null and _b is not null").drop("_mean")
    left = placed.select(block, "_a", "_b", F.col(key).alias("left"), F.col(pixels).alias("_left"))
    around = F.explode(F.array(*[F.struct((F.col("_a") + i).alias("_a"), (F.col("_b") + j).alias("_b")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_cell")
    right = placed.select(block, F.col(key).alias("right"), F.col(pixels).alias("_right"), around).select(block, "_cell.*", "right", "_right")
    return left, right


def value_priors(df: DataFrame, by: Sequence[str], grade: str, least: int, ends: int) -> DataFrame:
    """The ``ends`` lowest and highest shares of grade 0 among groups of at least ``least`` rows."""
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col(grade) == 0), F.count(F.lit(1))).alias("share_no_dr")).where(F.col("n") >= least)
    low = per.orderBy("share_no_dr", *by).limit(ends)
    high = per.orderBy(F.desc("share_no_dr"), *[F.desc(c) for c in by]).limit(ends)
    return low.unionByName(high).distinct()


def problems(df: DataFrame, key: str, split: str, rules: dict) -> DataFrame:
    """(key, split, issue, value): a row for each rule that a row breaks; rules give a text where broken, else null."""
    found = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(name).alias("issue"), v.cast("string").alias("value"))) for name, v in rules.items()]))
    return df.select(key, split, F.explode(found).alias("x")).select(key, split, "x.issue", "x.value")


def gap_counts(df: DataFrame, group: str, grade: str) -> DataFrame:
    """(gap, pairs): how far apart the conflicting grades of rows with the same content are, from a group's counts of each grade."""
    counts = df.where(F.col(grade).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.col(grade).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(group).agg(F.collect_list(F.struct("v", "n")).alias("vs"))  # an entry for each grade
    pairs = per.select(F.explode("vs").alias("a"), "vs").select("a", F.explode("vs").alias("b")).where("a.v < b.v")
    return pairs.groupBy((F.col("b.v") - F.col("a.v")).alias("gap")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("pairs"))


def near_square(aspect: Column, off: float = 0.02) -> Column:
    return (aspect > 1 - off) & (aspect < 1 + off)


def class_medians(df: DataFrame, grade: str, columns: Sequence[str], aspect: str) -> DataFrame:
    """(grade, n, near_square_share, median of each column) by grade."""
    out = df.groupBy(grade).agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(near_square(F.col(aspect))), F.count(aspect)).alias("near_square_share"))
    for c in columns:
        out = out.join(median(df, c, [grade]).select(grade, F.col("median").alias(f"median_{c}")), grade, "left")
    return out


def readable(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``columns`` all have a value that is not empty and no NaN."""
    ok = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "NaN")
    return df.where(reduce(Column.__and__, map(ok, columns)))


def leader_groups(df: DataFrame, block: str, key: str, pixels: str, least_corr: float, most_mae: float) -> DataFrame:
    """(block, key, head): greedy groups among rows with an equal hash: a row joins the first head, in order of keys, that it resembles.

    A row that resembles no head becomes one. Members are compared with heads only, so two members of a group may differ.
    Copies of one image are compared once. A task walks a block in order and holds its heads, nothing else of it: a block must
    have no more heads than a task can hold.
    """
    schema = StructType([df.schema[block], df.schema[key], StructField("head", df.schema[key].dataType)])
    once = df.groupBy(block, pixels).agg(F.min(key).alias(key))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, names, heads, units = None, [], np.empty((0, 0)), np.empty((0, 0))
        for frame in frames:
            out = []
            for b, k, image in zip(frame[block], frame[key], frame[pixels], strict=True):
                image = np.asarray(image, float)
                unit = _unit(image)
                if b != current:
                    current, names, heads, units = b, [], np.empty((8, len(image))), np.empty((8, len(image)))
                n = len(names)
                like = np.flatnonzero(units[:n] @ unit >= least_corr)
                like = like[np.abs(heads[like] - image).mean(axis=1) <= most_mae]
                if len(like):
                    out.append(names[like[0]])
                    continue
                if n == len(heads):  # twice the room, so that heads are copied a few times only
                    heads, units = (np.concatenate([x, np.empty_like(x)]) for x in (heads, units))
                heads[n], units[n] = image, unit
                names.append(k)
                out.append(k)
            yield pd.DataFrame({block: frame[block], key: frame[key], "head": out})

    placed = once.select(block, key, pixels).repartition(block).sortWithinPartitions(block, key).mapInPandas(walk, schema)
    first = placed.select(block, F.col(key).alias("_first"), "head").join(once.select(block, F.col(key).alias("_first"), pixels), [block, "_first"])
    return df.join(first, [block, pixels]).select(block, key, "head")


def _unit(image: np.ndarray) -> np.ndarray:
    """Centred and of length 1; undefined without contrast."""
    off = image - image.mean()
    with np.errstate(invalid="ignore", divide="ignore"):
        return off / np.sqrt(off @ off)
