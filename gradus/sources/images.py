"""Per-image measures by Arrow functions over Spark's image source: pixels never leave the task that decoded them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The crop's tolerance, the brightness gates, the hash's side.
TOLERANCE, DARK, BRIGHT, SIDE = 7, 8.0, 250.0, 8

STATS = (
    "origin string, readable boolean, width int, height int, channels int, brightness double, contrast_std double, black_ratio double, "
    "crop_width int, crop_height int, color_mode string, dhash string, too_dark boolean, too_bright boolean"
)


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image, or its only channel."""
    if image.shape[2] < 3:
        return image[:, :, 0].astype(float)
    return image[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299])


def auto_crop(image: np.ndarray, tolerance: int = TOLERANCE) -> np.ndarray:
    """The rows and columns that hold any pixel brighter than ``tolerance``; the whole image if none does."""
    mask = image.max(axis=2) > tolerance
    if not mask.any():
        return image
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return image[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, counting cut pixels by their share."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])
        at = np.linspace(0, a.shape[0], n + 1)
        whole = np.minimum(at.astype(int), a.shape[0] - 1)
        upto = sums[whole] + (at - whole)[:, None] * a[whole]
        return np.diff(upto, axis=0) * n / a.shape[0]

    return along(along(plane.astype(float), height).T, width).T


def pad_to_square(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    n = max(h, w)
    out = np.zeros((n, n, image.shape[2]), image.dtype)
    out[(n - h) // 2 : (n - h) // 2 + h, (n - w) // 2 : (n - w) // 2 + w] = image
    return out


def difference_hash(image: np.ndarray, side: int = SIDE) -> str:
    small = area_resize(gray(image), side, side + 1)
    bits = "".join("1" if b else "0" for b in (small[:, 1:] > small[:, :-1]).ravel())
    return f"{int(bits, 2):0{side * side // 4}x}"


def measure(image: np.ndarray) -> tuple:
    plane, cropped = gray(image), auto_crop(image)
    color = image.shape[2] >= 3 and bool((np.ptp(image[:, :, :3].astype(int), axis=2) > 2).any())
    mean = float(plane.mean())
    return (
        image.shape[1], image.shape[0], image.shape[2], mean, float(plane.std()), float((plane <= TOLERANCE).mean()), cropped.shape[1], cropped.shape[0],
        "color" if color else "gray", difference_hash(image), mean < DARK, mean > BRIGHT,
    )


def image_stats(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """A row for each image under ``path``; an unreadable file is a row with readable false and nulls, not an error."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATS.split(", ")]
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.height <= 0:
                    rows.append((r.origin, False, *[None] * (len(names) - 2)))
                else:
                    rows.append((r.origin, True, *measure(pixels(r.data, r.height, r.width, r.nChannels))))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("width", "height", "channels", "crop_width", "crop_height")})

    images = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("dropInvalid", False).load(path)
    return images.select("image.*").mapInPandas(scan, STATS)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def to_square(image: np.ndarray, size: int, mode: str = "squash") -> np.ndarray:
    """The image as ``size`` x ``size``: with black bars (``pad``), or with its sides scaled apart (``squash``)."""
    if mode not in ("pad", "squash"):
        raise ValueError(f"neither pad nor squash: {mode!r}")
    whole = pad_to_square(image) if mode == "pad" else image
    planes = [area_resize(whole[:, :, c], size, size) for c in range(whole.shape[2])]
    return np.clip(np.round(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)


def prepare(image: np.ndarray | None, size: int, mode: str = "squash") -> tuple[np.ndarray | None, str | None]:
    """The cropped square, or None and the reason why there is none."""
    if image is None:
        return None, "unreadable"
    level = gray(image).mean()
    if level < DARK or level > BRIGHT:
        return None, "too dark" if level < DARK else "too bright"
    return to_square(auto_crop(image), size, mode), None


def prepared(spark: SparkSession, path: str, size: int, mode: str = "squash", pattern: str = "*.png") -> DataFrame:
    """(origin, size, image, error): a row for each file; rejected ones have a reason and no image."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                image, error = prepare(pixels(r.data, r.height, r.width, r.nChannels) if r.height > 0 else None, size, mode)
                rows.append((r.origin, size, None if image is None else image.tobytes(), error))
            yield pd.DataFrame(rows, columns=["origin", "size", "image", "error"])

    images = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("dropInvalid", False).load(path)
    return images.select("image.*").mapInPandas(work, "origin string, size int, image binary, error string")


def thumbnails(spark: SparkSession, path: str, side: int = 128, pattern: str = "*.png") -> DataFrame:
    """(origin, thumb array<float>): gray thumbnails, made once for all comparisons of an image; unreadable files have none."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            small = [area_resize(gray(pixels(r.data, r.height, r.width, r.nChannels)), side, side).ravel().astype(np.float32) if r.height > 0 else None for r in frame.itertuples(index=False)]
            yield pd.DataFrame({"origin": frame["origin"], "thumb": small})

    images = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("dropInvalid", False).load(path)
    return images.select("image.*").mapInPandas(work, "origin string, thumb array<float>")


#: Fixed value: the level above which a pixel counts as tissue, a little above the crop's.
TISSUE = 10


def concentration(heat: Column, level: Column) -> Column:
    """(mass, area, ratio) of a heat map on the pixels of an image that are brighter than TISSUE, from two arrays of equal length.

    Mass and ratio are null where there is no heat, or where all or no pixels are tissue.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))
    area = total(F.transform(level, lambda v: F.when(v > TISSUE, 1.0).otherwise(0.0))) / F.size(level)
    inside = total(F.zip_with(heat, level, lambda h, v: F.when(v > TISSUE, h).otherwise(0.0)))
    mass = F.when((total(heat) > 0) & (area > 0) & (area < 1), inside / total(heat))
    return F.struct(mass.alias("mass"), area.alias("area"), (mass / area).alias("ratio"))


def concentration_by(df: DataFrame, by: str) -> DataFrame:
    """(by, n, mass, area, ratio): rows of each group, and the means of the three measures over those that have them."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("mass", "area", "ratio")])


def draw_spread(df: DataFrame, by: str, draw: str, value: str) -> DataFrame:
    """(by, draws, n, mean, sd, low, high): how far the means of a group's draws are apart; ``sd`` is null for one draw.

    Draws weigh alike, however many rows they have; rows without a value count for none.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(by, draw).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"))
    return per.groupBy(by).agg(F.count(F.lit(1)).alias("draws"), F.sum("n").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.min("m").alias("low"), F.max("m").alias("high"))
