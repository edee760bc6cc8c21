"""Scalar expressions on scores, grades, counts, names and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grades' names and the grade from which an eye is referred.
GRADE_NAMES = ("No DR", "Mild", "Moderate", "Severe", "Proliferative DR")
REFERABLE_FROM = 2
CUTS = (0.5, 1.5, 2.5, 3.5)
Z95 = 1.96


def digitize(score: Column, cuts: Sequence[float] = CUTS) -> Column:
    """The number of cuts at or below the score: a score equal to a cut has the upper grade. Null stays null."""
    if list(cuts) != sorted(set(cuts)):
        raise ValueError("cuts must strictly increase")
    return sum((F.when(score >= F.lit(float(c)), 1).otherwise(0) for c in cuts), F.when(score.isNotNull(), 0))


def referable(grade: Column) -> Column:
    return grade >= REFERABLE_FROM


def grade_name(grade: Column) -> Column:
    """The grade's name; null for anything but 0 to 4."""
    return F.get(F.array(*[F.lit(n) for n in GRADE_NAMES]), grade)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0: undefined rates are never 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """(low, high) of Wilson's interval for k of n, within 0 and 1; null for n = 0."""
    p, z2n = ratio(k, n), F.try_divide(F.lit(z * z), n.cast("double"))
    centre = p + z2n / 2
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")) + z2n / (4 * n))
    bound = lambda x: F.least(F.greatest(x / (1 + z2n), F.lit(0.0)), F.lit(1.0))
    return F.when(n > 0, F.struct(bound(centre - half).alias("low"), bound(centre + half).alias("high")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def odds(p: Column) -> Column:
    return F.try_divide(p, 1 - p)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def expected_grade(logits: Column) -> Column:
    """The sum of the cumulative probabilities of an array of logits."""
    return F.aggregate(F.transform(logits, sigmoid), F.lit(0.0), lambda a, x: a + x)


def cumulative_targets(grade: Column) -> Column:
    """[grade > 0, ..., grade > 3] as 0 and 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(CUTS) - 1)), lambda k: (grade > k).cast("int"))


def cutpoints(first: Column, gaps: Column) -> Column:
    """Increasing cuts: ``first``, then running sums of softplus(gap)."""
    step = lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + F.log1p(F.exp(g))))
    return F.aggregate(gaps, F.array(first), step)


def stem(name: Column) -> Column:
    """A file name without folder and last suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def pair_key(left: Column, right: Column) -> Column:
    """A key of an unordered pair: the SHA-256 of both, sorted, with a NUL between."""
    return F.concat(F.lit("exam:"), F.sha2(F.array_join(F.array_sort(F.array(left, right)), "\0"), 256))


def resolution_bucket(width: Column, height: Column) -> Column:
    return F.when((width == 1050) & (height == 1050), "1050x1050").otherwise("other")


def hash32(text: Column) -> Column:
    """The first 32 bits of the text's md5, as another engine computes them too."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def geometry(width: Column, height: Column, size_bytes: Column) -> dict[str, Column]:
    """Derived image columns; halves round to even as floating numbers do."""
    w, h = width.cast("double"), height.cast("double")
    return {"megapixels": F.bround(w * h / 1e6, 3), "aspect_ratio": F.bround(w / h, 4), "file_kb": F.bround(size_bytes.cast("double") / 1024, 1)}


def crop_saving(width: Column, height: Column, crop_width: Column, crop_height: Column) -> Column:
    """The share of the pixels that a crop leaves out."""
    return 1 - ratio(crop_width.cast("long") * crop_height, width.cast("long") * height)


def shown(x: Column, digits: int = 3) -> Column:
    """A number as text, N/A where it is undefined."""
    return F.when(finite(x), F.format_string(f"%.{digits}f", x)).otherwise("N/A")


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)


def similarity(left: Column, right: Column) -> Column:
    """(corr, mae) of two arrays of equal length; corr is null where one is constant."""
    ml, mr = mean(left), mean(right)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    cov = total(F.zip_with(left, right, lambda a, b: (a.cast("double") - ml) * (b.cast("double") - mr)))
    spread = lambda xs, m: total(F.transform(xs, lambda x: (x.cast("double") - m) * (x.cast("double") - m)))
    mae = total(F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")))) / F.size(left)
    return F.struct(F.try_divide(cov, F.sqrt(spread(left, ml) * spread(right, mr))).alias("corr"), mae.alias("mae"))


def difference_hash(pixels: Column, side: int) -> Column:
    """A bit for each pair of neighbours in a row of a side x side image, 1 where brightness rises; as text of 0 and 1."""
    at = F.filter(F.sequence(F.lit(0), F.lit(side * side - 2)), lambda i: i % side != side - 1)
    return F.array_join(F.transform(at, lambda i: F.when(F.get(pixels, i + 1) > F.get(pixels, i), "1").otherwise("0")), "")
