"""Stratified folds, groups of files, examinations and their partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.scalars import hash32
from gradus.operators.checks import ContractError
from gradus.operators.joins import join_one_to_one
from gradus.operators.ranges import numbered, running


def stratified_folds(df: DataFrame, key: str, strata: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold`` from 1 to k: each stratum is dealt in order of a seeded hash, so folds differ by one row in a stratum."""
    order = hash32(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    dealt = numbered(df, order, [key], strata)
    return dealt.withColumn("fold", (F.col("_place") % k + 1).cast("int")).drop("_place", "_rows")


def row_order_folds(df: DataFrame, order: str, strata: str, k: int) -> DataFrame:
    """Adds ``fold`` from 1 to k, without shuffling: each stratum is cut in order of rows into k runs.

    ``order`` is a number that no two rows share. Strata stand one after another, by their first row, and their places are dealt
    to the folds in turn; a stratum's run in a fold is as long as the fold has places in it, so folds differ by one row at most.
    """
    # A row for each stratum.
    sizes = df.groupBy(strata).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(F.col(strata).alias("_stratum"), "_n", (F.sum("_n").over(Window.orderBy("_first")) - F.col("_n")).alias("_start"))
    # Strata go by their start, which a stratum of nulls has too.
    placed = numbered(df.join(starts, F.col(strata).eqNullSafe(F.col("_stratum"))), F.col(order), [order], ["_start"])
    upto = lambda end, fold: F.floor((end - fold + k - 1) / k)
    fold, whole = F.lit(1), F.lit(0)
    for i in range(k):
        whole = whole + upto(F.col("_start") + F.col("_n"), i) - upto(F.col("_start"), i)
        fold = fold + (F.col("_place") >= whole).cast("int")
    return placed.withColumn("fold", fold.cast("int")).select(*df.columns, "fold")


def group_folds(df: DataFrame, group: str, strata: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: whole groups are dealt within (stratum, size), so folds share no group and are about equally mixed.

    A group's stratum is its highest value. Order of rows has no effect.
    """
    groups = df.groupBy(group).agg(F.max(strata).alias("_top"), F.count(F.lit(1)).alias("_size"))
    dealt = stratified_folds(groups, group, ["_top", "_size"], k, seed).select(group, "fold")
    return df.join(dealt, group)


#: Different class vectors that the driver deals out; a longer histogram is made coarser.
VECTORS = 1 << 16


def deal_vectors(histogram: Sequence[tuple[Sequence[int], int]], k: int) -> list[list[int]]:
    """The folds (from 1) of what is left of each vector's groups when as many as possible have gone to all folds alike.

    ``histogram`` has (class counts, groups). Larger vectors go first; each of a vector's last ``groups % k`` groups goes to the
    fold in which the squares of all class shares grow least, the first one of equals.
    """
    totals = [float(sum(v[c] * n for v, n in histogram)) ** 2 or 1.0 for c in range(len(histogram[0][0]) if histogram else 0)]
    sums = [[0] * len(totals) for _ in range(k)]
    dealt: list[list[int]] = [[] for _ in histogram]
    for at in sorted(range(len(histogram)), key=lambda i: (-sum(histogram[i][0]), [-x for x in histogram[i][0]])):
        vector, n = histogram[at]
        for _ in range(n % k):
            cost = []
            for held in sums:
                grown = 0.0
                for s, v, t in zip(held, vector, totals, strict=True):
                    grown += (2 * s * v + v * v) / t
                cost.append(grown)
            best = cost.index(min(cost))
            dealt[at].append(best + 1)
            sums[best] = [s + v for s, v in zip(sums[best], vector, strict=True)]
    return dealt


def class_vectors(df: DataFrame, group: str, grade: str, classes: int = 5) -> DataFrame:
    """(group, vector): how many rows of each class a group has."""
    counts = [F.count_if(F.col(grade) == g).cast("long") for g in range(classes)]
    return df.groupBy(group).agg(F.array(*counts).alias("vector"))


def balanced_group_folds(df: DataFrame, group: str, grade: str, k: int, seed: int = 42, classes: int = 5, vectors: int = VECTORS) -> DataFrame:
    """Adds ``fold``: whole groups, dealt so that every fold has about the same share of each class.

    Groups with the same class counts are alike, so the driver deals their histogram (``deal_vectors``) and a group's fold
    follows from its rank, by a seeded hash, among those with its vector. The histogram has a row for each different vector; if
    it has more than ``vectors``, counts are rounded down to multiples of 2, 4, ... until it has not. Order of rows has no
    effect. A null group gets no fold.
    """
    spark, shift = df.sparkSession, 0
    exact = class_vectors(df.where(F.col(group).isNotNull()), group, grade, classes)
    while True:
        groups = exact if not shift else exact.withColumn("vector", F.transform("vector", lambda n: F.shiftleft(F.shiftright(n, shift), shift)))
        if groups.select("vector").distinct().limit(vectors + 1).count() <= vectors:
            break
        shift += 1
    histogram = [(tuple(r.vector), r.n) for r in groups.groupBy("vector").agg(F.count(F.lit(1)).alias("n")).collect()]
    rows = [(list(v), n // k * k, d) for (v, n), d in zip(histogram, deal_vectors(histogram, k), strict=True)]
    left = spark.createDataFrame(rows, "vector array<long>, _even long, _left array<int>")
    order = hash32(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    ranked = numbered(groups.withColumn("_vector", F.array_join("vector", ",")), order, [group], ["_vector"])
    place = F.col("_place").cast("int")
    fold = F.when(place < F.col("_even"), place % k + 1).otherwise(F.get("_left", (place - F.col("_even")).cast("int")))
    return df.join(ranked.join(left, "vector").select(group, fold.cast("int").alias("fold")), group, "left")


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def middle_row(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row in the middle of each group, the later one of two, in order of a number and of columns that leave no ties."""
    return numbered(df, F.col(order[0]), order[1:], by).where(F.col("_place") == F.floor(F.col("_rows") / 2)).drop("_place", "_rows")


def filename_groups(df: DataFrame, name: str) -> DataFrame:
    """Adds ``group``: the date before the first ``_``, or the chain of consecutive numbers of names like IM000012."""
    number = F.regexp_extract(name, r"^IM(\d+)", 1)
    dated = df.where(number == "").withColumn("group", F.concat(F.lit("date:"), F.split_part(F.col(name), F.lit("_"), F.lit(1))))
    chained = df.where(number != "").withColumn("_n", number.cast("long"))
    distinct = chained.groupBy("_n").count()
    # Chains are runs of one sequence over all files. A number ends its chain unless the next one follows it; a repeated
    # number starts a chain each time.
    ended = running(distinct.withColumn("_at", F.col("_n")), "_n", ["count"], ahead=["_at"])
    breaks = F.when(F.col("_at_next") == F.col("_n") + 1, 0).otherwise(1)
    starts = running(ended.select("_n", "count", breaks.alias("_ends"), (F.col("count") - 1).alias("_more")), "_n", ["_ends", "_more"])
    starts = starts.select("_n", "count", (F.col("_ends_before") + F.col("_more_before") + F.col("count") - 1).alias("_last"))
    order = Window.partitionBy("_n").orderBy(name)
    out = chained.withColumn("_k", F.row_number().over(order)).join(starts, "_n")
    out = out.withColumn("group", F.concat(F.lit("im:"), (F.col("_last") - F.col("count") + F.col("_k")).cast("string")))
    return dated.unionByName(out.select(*dated.columns))


def examination_parts(df: DataFrame, exam: str, part: str) -> DataFrame:
    """(exam, images, parts): each examination's images and sorted set of partitions."""
    return df.groupBy(exam).agg(F.count(F.lit(1)).alias("images"), F.array_sort(F.collect_set(part)).alias("parts"))


def examination_audit(df: DataFrame, exam: str, part: str, test: str = "test") -> DataFrame:
    """One row: examinations, complete pairs, single eyes, those that cross partitions, those that cross into the test part."""
    parts, crosses = examination_parts(df, exam, part), F.size("parts") > 1
    return parts.agg(
        F.count(F.lit(1)).alias("examinations"), F.count_if(F.col("images") == 2).alias("complete_pairs"), F.count_if(F.col("images") == 1).alias("single_eyes"),
        F.count_if(crosses).alias("crossing"), F.count_if(crosses & F.array_contains("parts", test)).alias("test_crossing"),
    ).withColumn("disjoint", F.col("crossing") == 0)


def part_combinations(df: DataFrame, exam: str, part: str) -> DataFrame:
    return examination_parts(df, exam, part).groupBy(F.array_join("parts", " + ").alias("combination")).agg(F.count(F.lit(1)).alias("examinations"))


def split_plan(df: DataFrame, part: str, exam: str, grade: str) -> DataFrame:
    """(part, eyes, examinations, referable, grade_0..4)."""
    grades = [F.count_if(F.col(grade) == g).alias(f"grade_{g}") for g in range(5)]
    return df.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("eyes"), F.countDistinct(exam).alias("examinations"), F.count_if(F.col(grade) >= 2).alias("referable"), *grades)


def transitions(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.groupBy(F.col(old).alias("old_part"), F.col(new).alias("new_part")).agg(F.count(F.lit(1)).alias("n"))


PARTS = ("tune-train", "tune-valid", "test")


def pool_and_holdout(df: DataFrame, split: str, pool: Sequence[str] = ("train", "valid")) -> DataFrame:
    """Adds ``part``: ``pool`` for rows of the splits that folds are made of, else ``holdout``; the split stays."""
    return df.withColumn("part", F.when(F.col(split).isin(*pool), "pool").otherwise("holdout"))


def nested_split(df: DataFrame, group: str, strata: str, seed: int = 42, balanced: bool = False) -> DataFrame:
    """Adds ``part`` of PARTS: half of the groups for test, a fifth of the others for validation; groups stay whole.

    ``balanced`` deals groups by all their classes (``balanced_group_folds``), else by their highest and their size.
    """
    folds = balanced_group_folds if balanced else group_folds
    halves = folds(df, group, strata, 2, seed).withColumnRenamed("fold", "_half")
    rest = folds(halves.where("_half = 2"), group, strata, 5, seed)
    inner = rest.select("*", F.when(F.col("fold") == 1, PARTS[1]).otherwise(PARTS[0]).alias("part")).drop("fold", "_half")
    return halves.where("_half = 1").drop("_half").withColumn("part", F.lit(PARTS[2])).unionByName(inner)


def filename_split(df: DataFrame, name: str, grade: str, seed: int = 42) -> DataFrame:
    """Adds ``group`` (as ``filename_groups``) and ``part`` of PARTS: files of one date or chain of numbers stay together."""
    return nested_split(filename_groups(df, name), "group", grade, seed)


def small_strata(df: DataFrame, strata: Sequence[str], k: int) -> DataFrame:
    """(strata, n) of the strata with fewer rows than folds, which leave folds uneven."""
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def split_check(df: DataFrame, reference: DataFrame, key: str, grade: str, exam: str, part: str) -> DataFrame:
    """One row: do the split's ids and grades equal the reference's, are all parts known, examinations whole, both classes in each part."""
    both = df.select(key, F.col(grade).alias("_a"), F.lit(1).alias("_l")).join(reference.select(key, F.col(grade).alias("_b"), F.lit(1).alias("_r")), key, "full_outer")
    ids = both.agg((F.count_if(F.col("_l").isNull() | F.col("_r").isNull()) == 0).alias("same_ids"), (F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))) == 0).alias("same_grades"))
    per = df.groupBy(part).agg(F.count_if(F.col(grade) >= 2).alias("ill"), F.count(F.lit(1)).alias("n"))
    known = F.coalesce(F.col(part).isin(*PARTS), F.lit(False))
    parts = per.agg((F.count_if(~known) == 0).alias("known_parts"), (F.count_if((F.col("ill") == 0) | (F.col("ill") == F.col("n"))) == 0).alias("both_classes"))
    # One row beside one row.
    return ids.crossJoin(parts).crossJoin(examination_audit(df, exam, part).select("disjoint"))


def exposures(old: DataFrame, new: DataFrame, key: str, part: str, test: str = PARTS[2]) -> DataFrame:
    """(old_part, new_part, n, exposed): the rows of both splits by part; ``exposed`` ones are tested now and were developed on before."""
    both = join_one_to_one(old.select(key, F.col(part).alias("old_part")), new.select(key, F.col(part).alias("new_part")), key, complete=True)
    return both.groupBy("old_part", "new_part").agg(F.count(F.lit(1)).alias("n")).withColumn("exposed", (F.col("new_part") == test) & (F.col("old_part") != test))


def training_arms(df: DataFrame, part: str, target: str, pseudo: str) -> DataFrame:
    """A row of each arm for each training row, with the arm's ``target``: the control arm learns from ``pseudo``; validation rows keep theirs."""
    rows = df.where(F.col(part).isin(*PARTS[:2])).withColumn("arm", F.explode(F.array(F.lit("adjudicated"), F.lit("control"))))
    return rows.withColumn(target, F.when((F.col("arm") == "control") & (F.col(part) == PARTS[0]), F.col(pseudo)).otherwise(F.col(target)))


def smoke_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows that come first in a seeded shuffle; the limit is the feature."""
    return df.orderBy(hash32(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


def out_of_fold(assigned: DataFrame, scores: DataFrame, key: str, fold: str) -> DataFrame:
    """Each row of ``assigned`` with the score of the model that held it out; every row must have exactly one."""
    found = assigned.join(scores, [key, fold], "left")
    bad = found.groupBy(key).agg(F.count("raw").alias("n")).where("n <> 1").limit(5).collect()
    if bad:
        raise ContractError(f"not scored once by the model that held them out: {[r[0] for r in bad]}")
    return found
