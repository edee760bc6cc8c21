import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import scalars as S
from gradus.operators import audits, checks, curves, joins, metrics, quality, ranges, resample, splits, stats
from gradus.plans import reports
from gradus.plans.adapters import preds
from gradus.plans.shared import graded


def vectors(spark, truth, pred, **more):
    rows = list(zip(range(len(truth)), truth, pred, *more.values(), strict=True))
    return spark.createDataFrame(rows, ", ".join(["i int", "t int", "p int", *[f"{k} string" for k in more]]))


def test_stratified_report(spark):
    df = vectors(spark, [0, 0, 0, 2, 0, 1, 2, 4], [0, 0, 0, 2, 0, 1, 2, 3], s=list("ssssoooo"))
    rows = {r.s: r for r in metrics.stratified_report(df, "t", "p", "s").collect()}
    assert set(rows) == {"s", "o", "ALL"} and rows["s"].majority_acc == 0.75 and rows["s"].qwk == 1


def test_kappa_spaces(spark):
    df = vectors(spark, [0, 2, 4, 4, 0, 2], [0, 4, 4, 2, 2, 2])
    cells = metrics.cells(df, "t", "p")

    def matrix(t, p):
        k = 1 + max(max(t), max(p))
        o = np.zeros((k, k))
        np.add.at(o, (t, p), 1)
        w = (np.arange(k)[:, None] - np.arange(k)) ** 2
        return 1 - (w * o).sum() / (w * np.outer(o.sum(1), o.sum(0)) / o.sum()).sum()

    assert metrics.qwk(cells).first().qwk == pytest.approx(matrix([0, 2, 4, 4, 0, 2], [0, 4, 4, 2, 2, 2]))
    assert metrics.qwk(cells, observed=True).first().qwk == pytest.approx(matrix([0, 1, 2, 2, 0, 1], [0, 2, 2, 1, 1, 1]))
    assert metrics.qwk(metrics.cells(vectors(spark, [1, 1], [1, 1]), "t", "p")).first().qwk is None


def test_referral_slices(spark):
    df = vectors(spark, [0, 1, 2, 2, 2, 3, 4], [0, 2, 1, 2, 3, 1, 4])
    rows = {r.grade: r for r in metrics.referral_breakdown(metrics.cells(df, "t", "p")).collect()}
    assert rows[2].missed_referable == 1 and rows[2].sensitivity == pytest.approx(2 / 3) and rows[1].false_referral_fraction == 1.0
    rows = {r.grade: r for r in metrics.referral_breakdown(metrics.cells(df.where("t <> 4"), "t", "p")).collect()}
    assert rows[4].n == 0 and rows[4].sensitivity is None


def test_discordance(spark):
    base, cand = [0, 1, 1, 2, 2, 0, 3], [0, 1, 2, 1, 2, 1, 1]
    df = vectors(spark, [0, 2, 2, 2, 3, 3, 4], base, c=[str(c) for c in cand]).withColumn("c", F.col("c").cast("int"))
    rows = {r.grade: tuple(r)[1:] for r in metrics.paired_discordance(df, "t", "p", "c").collect()}
    assert rows["grade_2"] == (3, 1, 1, 1, 0) and rows["all_referable"] == (6, 2, 1, 2, 1)


def test_digitize_is_right_open_and_nulls_stay(spark):
    df = spark.createDataFrame([(0.5,), (0.49,), (3.5,), (None,)], "x double")
    assert [r[0] for r in df.select(S.digitize(F.col("x"))).collect()] == [1, 0, 4, None]
    with pytest.raises(ValueError):
        S.digitize(F.col("x"), [1, 1])


def roc(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp, fp = np.cumsum(y)[last], (1 + last) - np.cumsum(y)[last]
    keep = np.r_[True, (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0), True] if len(fp) > 2 else np.ones(len(fp), bool)
    return s[last][keep], tp[keep] / y.sum(), fp[keep] / (1 - y).sum()


def test_curves(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    counts = curves.score_counts(df, F.col("y") == 1, "s")
    got = curves.roc_corners(curves.roc_points(counts)).orderBy(F.desc("score")).collect()
    cut, tpr, fpr = roc(y, s)
    assert np.allclose([r.score for r in got], cut) and np.allclose([r.tpr for r in got], tpr) and np.allclose([r.fpr for r in got], fpr)
    pos, neg = s[y == 1], s[y == 0]
    assert curves.auc(counts).first().auc == pytest.approx(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2))
    point = curves.operating_point(counts, min_sensitivity=0.9).first()
    assert point.cut == cut[np.argmax(tpr >= 0.9)]
    assert curves.auc(curves.score_counts(df.where("y = 1"), F.col("y") == 1, "s")).first().auc is None


def test_calibration_bins_are_half_open(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 0), (0.3, 1), (0.30000000000000004, 1), (1.0, 1)], "p double, y int")
    rows = {r.bin: r.n for r in curves.reliability(df, F.col("y") == 1, "p").collect()}
    assert rows == {0: 2, 2: 2, 9: 1}
    with pytest.raises(ValueError):
        curves.decision_curve(df, F.col("y") == 1, "p", thresholds=[0.5, 1.0])


def test_bootstrap_of_equal_models_has_no_width(spark):
    rows = spark.createDataFrame([(f"p{i:02d}", i % 2, 1 - i % 2) for i in range(20)], "c string, pos long, neg long")
    clusters = resample.numbered(rows, "c")
    assert sorted(r.place for r in clusters.collect()) == list(range(20)) and clusters.first().clusters == 20
    drawn = resample.draws(clusters, 10).groupBy("draw").agg(F.sum("times").alias("n")).collect()
    assert {r.n for r in drawn} == {20} and len(drawn) == 10
    values = resample.resampled(clusters, ["pos", "neg"], 10).select("draw", (F.col("pos") * 0.0).alias("d"), F.lit(None).cast("double").alias("u"))
    got = {r.metric: r for r in resample.interval(values, ["d", "u"], 10).collect()}
    assert (got["d"].low, got["d"].high) == (0.0, 0.0) and got["u"].low is None


def test_draws_of_one_class_count_for_no_rate(spark):
    sums = spark.createDataFrame([(0, 4, 2, 3, 6, 5, 6), (1, 0, 0, 0, 10, 9, 8), (2, 10, 9, 8, 0, 0, 0)], "draw int, pos int, ta int, tb int, neg int, na int, nb int")
    got = {r.draw: tuple(r)[1:] for r in resample.paired_rates(sums).collect()}
    assert got == {0: (0.25, 1 / 6, 0.0), 1: (None, None, None), 2: (None, None, None)}
    limits = {r.metric: (r.valid, r.low) for r in resample.interval(resample.paired_rates(sums), ["sensitivity", "referral"], 3).collect()}
    assert limits == {"sensitivity": (1, None), "referral": (1, None)}


def test_filename_groups(spark):
    rnd = random.Random(3)
    numbers = sorted(rnd.sample(range(1, 90), 40))
    names = [f"{2000 + y}{m:02d}07_{k}_a" for y in range(3) for m in (2, 9) for k in range(y + 1)] + [f"IM{n:06d}" for n in numbers]
    want = {frozenset(n for n in names if n.startswith(day)) for day in {n[:8] for n in names if not n.startswith("IM")}}
    chain = []
    for n in numbers:
        if chain and n != chain[-1] + 1:
            want.add(frozenset(f"IM{x:06d}" for x in chain))
            chain = []
        chain.append(n)
    want.add(frozenset(f"IM{x:06d}" for x in chain))
    rnd.shuffle(names)
    by = {}
    for r in splits.filename_groups(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect():
        by.setdefault(r.group, set()).add(r.name)
    assert {frozenset(x) for x in by.values()} == want


def test_folds_keep_groups_and_rows(spark):
    df = spark.createDataFrame([(i, f"g{i // 2}", i % 5) for i in range(200)], "id int, g string, grade int")
    rows = splits.group_folds(df, "g", "grade", 5).collect()
    assert len(rows) == 200 and all(len({r.fold for r in rows if r.g == g}) == 1 for g in {r.g for r in rows})
    again = splits.group_folds(df.orderBy(F.desc("id")), "g", "grade", 5).collect()
    assert {(r.id, r.fold) for r in rows} == {(r.id, r.fold) for r in again}


def test_exam_audit(spark):
    df = spark.createDataFrame([("e1", "test"), ("e1", "train"), ("e2", "test")], "exam string, part string")
    r = splits.examination_audit(df, "exam", "part").first()
    assert (r.examinations, r.complete_pairs, r.single_eyes, r.crossing, r.test_crossing, r.disjoint) == (2, 1, 1, 1, 1, False)


def test_leaks_leave_train_only(spark):
    df = spark.createDataFrame([("x", "train"), ("x", "test"), ("y", "train")], "id_code string, split string")
    leak = spark.createDataFrame([("x",)], "id_code string")
    assert sorted(map(tuple, joins.drop_leaked(df, leak, "id_code").collect())) == [("x", "test"), ("y", "train")]
    with pytest.raises(checks.ContractError):
        joins.drop_leaked(df, leak.limit(0), "id_code")
    with pytest.raises(checks.ContractError):
        joins.join_one_to_one(df, leak, "id_code")
    with pytest.raises(checks.ContractError):
        joins.join_one_to_one(leak.union(spark.createDataFrame([("z",)], "id_code string")), leak, "id_code", complete=True)


def test_label_noise_counts_pairs_without_making_them(spark):
    rng = np.random.default_rng(1)
    data = [(int(g), i, int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 12, 60), rng.integers(0, 5, 60), strict=True))]
    got = quality.label_noise(spark.createDataFrame(data, "g int, i int, v int"), "g", "i", "v").first()
    pairs = [(a, b) for a in data for b in data if a[0] == b[0] and a[1] < b[1]]
    gaps = [abs(a[2] - b[2]) for a, b in pairs if a[2] != b[2]]
    assert (got.pairs, got.conflicts) == (len(pairs), len(gaps)) and got.mean_gap == pytest.approx(np.mean(gaps))


def test_mad_without_spread_finds_nothing(spark):
    assert quality.mad_outliers(spark.createDataFrame([(1.0,)] * 5 + [(9.0,)], "v double"), "v").count() == 0


def test_rank_and_tail_functions(spark):
    assert stats.chi2_sf(9.487729, 4) == pytest.approx(0.05, abs=1e-6) and stats.chi2_sf(0.7107, 4) == pytest.approx(0.95, abs=1e-4)
    assert stats.t_sf2(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(a), float(a + rng.normal())) for a in y], "y int, s double")
    slope, intercept = tuple(stats.platt(df, F.col("y") == 1, "s").first())
    x = np.array([r.s for r in df.collect()])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        g = np.array([((p - y) * x).sum() + w[0], (p - y).sum()])
        h = np.array([[(p * (1 - p) * x * x).sum() + 1, (p * (1 - p) * x).sum()], [(p * (1 - p) * x).sum(), (p * (1 - p)).sum()]])
        w -= np.linalg.solve(h, g)
    assert (slope, intercept) == pytest.approx(tuple(w), abs=1e-9)


def test_threshold_search(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(g + 0.8 + rng.normal(0, 0.15))) for g in range(5) for _ in range(40)]
    cuts, kappa = stats.optimise_cuts(spark.createDataFrame(rows, "t int, s double"), "t", "s")
    assert kappa > 0.97 and all(b - a >= 0.05 for a, b in zip(cuts, cuts[1:], strict=False))


def test_forest_reveals_a_shortcut(spark):
    rng = np.random.default_rng(0)
    rows = [(1050 if i % 2 else 2000, float(rng.random()), 0 if i % 2 else 2, i % 5) for i in range(120)]
    cells = stats.metadata_forest(spark.createDataFrame(rows, "w int, noise double, g int, fold int"), ["w", "noise"], "g", "fold", trees=10)
    assert metrics.grade_metrics(cells).first().accuracy > 0.95


def test_audits_find_tampering(spark):
    folds = spark.createDataFrame([("a", k, 0.9 + k / 100) for k in range(1, 6)] + [("b", 1, 0.5), ("b", 3, 0.6)], "v string, fold int, q double")
    s = audits.fold_summary(folds, ["v"], ["q"]).select("v", F.col("q_mean").alias("mean"), F.col("q_std").alias("std"))
    assert {r.v: r.passed for r in audits.sweep_audit(folds, s, ["v"], "q").collect()} == {"a": True, "b": False}
    off = s.withColumn("mean", F.col("mean") + 1e-3)
    assert not any(r.passed for r in audits.sweep_audit(folds, off, ["v"], "q").collect())
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, g int")
    same = audits.fingerprint(df.orderBy(F.desc("id")), "id", ["g"]).first()
    assert same == audits.fingerprint(df, "id", ["g"]).first() != audits.fingerprint(df.na.fill(0), "id", ["g"]).first()


def test_early_stop_ignores_later_epochs(spark):
    values = [0.1, 0.5, 0.5, 0.4, 0.3, 0.9]
    r = audits.best_epoch(spark.createDataFrame([("m", i + 1, v) for i, v in enumerate(values)], "m string, epoch int, value double"), ["m"], 3).first()
    assert (r.best_epoch, r.best, r.stopped_at) == (2, 0.5, 5)


def test_wilson_and_geometry(spark):
    r = spark.range(1).select(S.wilson(F.lit(8), F.lit(10)).alias("w"), S.wilson(F.lit(0), F.lit(0)).alias("none"), S.geometry(F.lit(1050), F.lit(1050), F.lit(2048))["megapixels"].alias("mp")).first()
    assert r.w.low == pytest.approx(0.4902, abs=1e-4) and r.none is None and r.mp == pytest.approx(1.102)
    assert math.isclose(spark.range(1).select(S.expected_grade(F.array(F.lit(0.0), F.lit(0.0)))).first()[0], 1.0)


def test_rules_count_nulls_as_broken(spark):
    df = spark.createDataFrame([(1,), (None,), (7,)], "g int")
    assert checks.violations(df, {"g": checks.is_grade("g")}).first().g == 2
    with pytest.raises(checks.ContractError):
        checks.require(df.limit(0), {"g": checks.is_grade("g")})


def test_forest_has_the_trees_and_depth_that_are_asked_for(spark, monkeypatch):
    """200 trees where nothing is said; steps of one feature that no tree of depth 5 can tell apart are learned at depth 30."""
    made, whole = [], stats._forest
    monkeypatch.setattr(stats, "_forest", lambda trees, seed, depth, leaf: made.append((trees, depth, leaf)) or whole(8, seed, depth, leaf))
    rows = [(float(i), (i // 16) % 2, i % 5 + 1) for i in range(512)]
    df = spark.createDataFrame(rows, "x double, g int, fold int").withColumn("same", F.lit(0.0))
    found = lambda **more: metrics.grade_metrics(stats.metadata_forest(df, ["x", "same"], "g", "fold", **more)).first().accuracy
    flat, deep = found(), found(depth=30)
    assert made[0] == (200, 5, 1e-4) and made[-1] == (200, 30, 1e-4) and flat < deep
    assert stats.metadata_forest(df.limit(0), ["x", "same"], "g", "fold").collect() == []


def test_importances_find_the_planted_features(spark):
    rng = np.random.default_rng(6)
    strong, weak, noise = rng.normal(size=(3, 400))
    grade = (strong * 2 + weak > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(g)) for a, b, c, g in zip(strong, weak, noise, grade, strict=True)], "a double, b double, c double, g int")
    found = [(r.feature, r.importance) for r in stats.feature_importances(df, ["c", "b", "a"], "g", trees=30).collect()]
    assert [f for f, _ in found] == ["a", "b", "c"] and found[0][1] > 2 * found[2][1] and math.isclose(sum(i for _, i in found), 1.0)


@pytest.mark.parametrize("strata", [[0, 0, 0, 1, 1, 2], [3, 1, 3, 3, 1, 2, 1, 3, 3, None, 3, 1, 1, 3, 2, 2, 3, None, 3]])
@pytest.mark.parametrize("k", [2, 5])
def test_row_order_folds_against_a_plain_deal(spark, strata, k):
    rows = [(10 * i, g) for i, g in enumerate(strata)]
    got = {r.id: r.fold for r in splits.row_order_folds(spark.createDataFrame(rows[::-1], "id long, g int"), "id", "g", k).collect()}
    firsts = list(dict.fromkeys(strata))
    stood = [g for f in firsts for g in strata if g == f]
    want = {}
    for g in firsts:
        runs = [f + 1 for f in range(k) for p in range(f, len(stood), k) if stood[p] == g]
        want |= dict(zip([10 * i for i, x in enumerate(strata) if x == g], runs, strict=True))
    assert got == want


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(str(rng.choice(list("ab"))), None if i == 7 else float(v), int(rng.integers(0, 9)), i) for i, v in enumerate(np.round(rng.normal(size=300), 1) + 0.0)]
    df = spark.createDataFrame(rows, "g string, v double, n int, i int")
    for down in (False, True):
        got = {r.i: r for r in ranges.running(df, "v", ["n"], ["g"], descending=down, ties=["i"], ahead=["i"], ranges=7).collect()}
        assert len(got) == 300
        for g in "ab":
            order = sorted((r for r in rows if r[0] == g), key=lambda r: ((-np.inf if r[1] is None else r[1]) * (-1 if down else 1), r[3]))
            before = 0
            for k, r in enumerate(order):
                follows = order[k + 1][3] if k + 1 < len(order) else None
                assert (got[r[3]].n_before, got[r[3]].n_all, got[r[3]].i_next) == (before, sum(x[2] for x in order), follows)
                before += r[2]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    data = {g: np.round(rng.normal(size=n), 1) for g, n in (("a", 101), ("b", 48), ("c", 1))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    at = [0, 0.05, 0.25, 0.5, 0.9, 1]
    for r in ranges.quantiles(df, "v", at, ["g"]).collect():
        assert r.n == len(data[r.g]) and np.allclose(r.q, np.quantile(data[r.g], at))
    assert ranges.median(df.where("g = 'none'"), "v").first().median is None and quality.summary(df, ["v"]).first().n == 150


def plain_search(truth, raw, start):
    """The coordinate search on the rows themselves."""
    score = lambda cuts: stats.observed_kappa(np.histogram2d(truth, np.digitize(raw, cuts), bins=[range(6), range(6)])[0])
    cuts, best = np.array(start), score(start)
    for _ in range(stats.ROUNDS):
        found = False
        for i in range(4):
            for step in stats.STEPS:
                tried = cuts.copy()
                tried[i] += step
                if (np.diff(tried) > stats.LEAST_GAP).all() and (k := score(tried)) > best:
                    cuts, best, found = tried, k, True
        if not found:
            break
    return cuts, best


def test_threshold_search_on_exact_scores(spark):
    rng = np.random.default_rng(8)
    for grades in ([0, 1, 2, 3, 4], [0, 2, 4]):
        truth = rng.choice(grades, 400)
        raw = truth + 0.3 + rng.normal(0, 0.5, 400)
        want, kappa = plain_search(truth, raw, [0.5, 1.5, 2.5, 3.5])
        got, best = stats.optimise_cuts(spark.createDataFrame([(int(t), float(x)) for t, x in zip(truth, raw, strict=True)], "t int, s double"), "t", "s")
        assert got == want.tolist() and best == pytest.approx(kappa, abs=1e-12) and got != [0.5, 1.5, 2.5, 3.5]


def test_exact_rank_test():
    from itertools import combinations

    for n1, n2 in ((3, 4), (5, 6)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            upper = max(u, n1 * n2 - u)
            assert stats.mann_whitney_p(u, n1, n2, 0.0, 1.0, False) == pytest.approx(min(1, 2 * sum(x >= upper for x in us) / len(us)))
    assert stats.mann_whitney_p(400, 20, 30, 1.96 + 0.05, 10.0, True) == pytest.approx(0.05, abs=1e-4)


def test_auc_of_draws_against_plain_draws(spark):
    rng = np.random.default_rng(9)
    rows = [(int(c), int(y), float(np.round(y + rng.normal(), 1)), arm) for c in range(25) for y in rng.integers(0, 2, 3) for arm in "ab"]
    df = spark.createDataFrame(rows, "c long, y int, s double, arm string")
    got = {(r.arm, r.draw): r.auc for r in resample.resampled_auc(df, "c", F.col("y") == 1, "s", "arm", 12).collect()}
    times = {(r.draw, r.place): r.times for r in resample.draws(resample.numbered(df.select("c").distinct(), "c"), 12).collect()}
    for (arm, draw), auc in got.items():
        pos, neg = ([(r[2], times.get((draw, r[0]), 0)) for r in rows if r[3] == arm and r[1] == y] for y in (1, 0))
        wins = sum(a * b * ((x > z) + (x == z) / 2) for x, a in pos for z, b in neg)
        assert auc == pytest.approx(wins / (sum(a for _, a in pos) * sum(b for _, b in neg)))
    assert len(got) == 24


def test_leader_groups_are_not_transitive(spark):
    near = lambda *v: [float(x) for x in v]
    rows = [("h", 1, near(0, 4, 8)), ("h", 2, near(0, 5, 9.5)), ("h", 3, near(0, 6, 11)), ("h", 4, near(0, 4, 8)), ("k", 5, near(0, 4, 8))]
    got = quality.leader_groups(spark.createDataFrame(rows, "b string, i int, x array<double>"), "b", "i", "x", 0.9, 1.0).collect()
    assert {r.i: r.head for r in got} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}  # 3 resembles 2, which is no head


def test_published_rates_and_rules(spark):
    good = ("a", 10, 0.4, 0.75, 5 / 6, 0.75, 0.4)
    rows = spark.createDataFrame([good, ("b", *good[1:5], 0.7, 0.4), ("c", 10, 0.43, *good[3:])], "cohort string, n long, prevalence double, sensitivity double, specificity double, ppv double, referral_rate double")
    got = {r.cohort: r for r in audits.reconstructed(rows, "cohort").collect()}
    assert (got["a"].tp, got["a"].fn, got["a"].tn, got["a"].fp, got["a"].consistent) == (3, 1, 5, 1, True)
    assert not got["b"].consistent and not got["c"].consistent and got["c"].tp is None
    grade = spark.createDataFrame([("a", 10, 4, 2), ("b", 11, 4, 0)], "cohort string, n long, referable long, missed long")
    both = {r.cohort: (r.difference, r.comparable) for r in audits.rule_comparison(audits.reconstructed(rows, "cohort"), grade, "cohort").collect()}
    assert both["a"] == (-1, True) and both["b"][1] is False and both["c"][1] is False


def test_out_of_fold_needs_one_score_for_each_row(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2)], "id int, fold int")
    scores = spark.createDataFrame([(1, 1, 0.5), (2, 2, 0.7), (2, 1, 0.1)], "id int, fold int, raw double")
    assert {r.id: r.raw for r in splits.out_of_fold(rows, scores, "id", "fold").collect()} == {1: 0.5, 2: 0.7}
    for broken in (scores.where("fold = 1"), scores.union(scores)):
        with pytest.raises(checks.ContractError):
            splits.out_of_fold(rows, broken, "id", "fold")


def test_stems_align_or_raise(spark):
    rows = spark.createDataFrame([("a.png",), ("b.png",)], "image string")
    files = spark.createDataFrame([("x/a.JPG",), ("x/b.PNG",), ("x/c.png",), ("y/c.png",)], "file string")
    assert sorted(r.image for r in joins.align_stems(rows, files, "image", "file").collect()) == ["x/a.JPG", "x/b.PNG"]
    for name in ("c.png", "d.png"):
        with pytest.raises(checks.ContractError):
            joins.align_stems(rows.union(spark.createDataFrame([(name,)], "image string")), files, "image", "file").collect()


def test_scored_rows_contract(spark):
    good = [("a ", "2", "0.5"), ("b", "4.0", "-1")]
    frame = lambda rows: spark.createDataFrame(rows, "id_code string, diagnosis string, raw string")
    assert [tuple(r) for r in checks.require_eyes(frame(good)).orderBy("id_code").collect()] == [("a", 2, 0.5), ("b", 4, -1.0)]
    for bad in (("a", "1", "0"), ("c", "2.5", "0"), ("c", "5", "0"), ("c", "1", "NaN"), ("c", "1", "x"), (" ", "1", "0"), (None, "1", "0")):
        with pytest.raises(checks.ContractError):
            checks.require_eyes(frame([*good, bad]))
    with pytest.raises(checks.ContractError):
        checks.require_eyes(frame([]))
    for cuts, ok in (([0.1, 0.2, 0.3, 0.4], True), ([0.1, 0.2, 0.2, 0.4], False), ([0.1], False), ([0.1, 0.2, float("nan"), 0.4], False), (None, False)):
        assert spark.createDataFrame([(cuts,)], "c array<double>").select(checks.valid_cuts(F.col("c"))).first()[0] is ok
    with pytest.raises(checks.ContractError):
        checks.require_cuts([0, 1, 1, 2])


def test_stored_columns_keep_a_bootstrap_whole(spark):
    """Fewer valid draws than the least share give no limits."""
    values = spark.createDataFrame([(i, float(i) if i < 7 else None) for i in range(10)], "draw int, d double")
    assert resample.interval(values, ["d"], 10).first().low is None and resample.interval(values, ["d"], 8).first().low is not None


def test_file_groups_stay_in_one_part(spark):
    names = [(f"{20050000 + i // 3}_{i}", i % 5) for i in range(240)] + [(f"IM{n:06d}", n % 5) for n in range(0, 200) if n % 9]
    rows = splits.filename_split(spark.createDataFrame(names, "name string, g int"), "name", "g").collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.group, set()).add(r.part)
    assert len(rows) == len(names) and all(len(p) == 1 for p in parts.values()) and {r.part for r in rows} == set(splits.PARTS)


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_generator_draws_give_the_limits_of_a_plain_bootstrap(spark, chunk):
    rnd = np.random.default_rng(8)
    patient, truth = np.sort(rnd.integers(0, 23, 90)), rnd.integers(0, 5, 90)
    base, cand = (np.clip(truth + rnd.integers(-2, 3, 90), 0, 4) for _ in range(2))
    names = sorted(set(map(int, patient)))
    rng, diffs = np.random.default_rng(42), []
    for _ in range(150):
        at = np.concatenate([np.flatnonzero(patient == names[i]) for i in rng.integers(0, len(names), size=len(names))])
        y, a, b = truth[at] >= 2, base[at] >= 2, cand[at] >= 2
        diffs.append((b[y].mean() - a[y].mean(), (~b[~y]).mean() - (~a[~y]).mean(), b.mean() - a.mean()))
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(patient, truth, base, cand)], "patient int, t int, a int, b int")
    y, a, b = (F.col(c) >= 2 for c in "tab")
    sums = {"pos": F.count_if(y), "ta": F.count_if(y & a), "tb": F.count_if(y & b), "neg": F.count_if(~y), "na": F.count_if(~y & ~a), "nb": F.count_if(~y & ~b)}
    clusters = resample.numbered(df.groupBy("patient").agg(*[c.alias(n) for n, c in sums.items()]), "patient")
    drawn = resample.generator_draws(spark, len(names), 150, 42, chunk)
    rates = resample.paired_rates(resample.resampled_by(clusters, list(sums), drawn))
    got = {r.metric: (r.valid, r.low, r.high) for r in resample.interval(rates, ["sensitivity", "specificity", "referral"], 150).collect()}
    for i, metric in enumerate(["sensitivity", "specificity", "referral"]):
        low, high = np.quantile([d[i] for d in diffs], [0.025, 0.975])
        assert got[metric][0] == 150 and got[metric][1:] == pytest.approx((low, high), abs=1e-12)


def test_generator_draws_of_one_cluster(spark):
    assert {tuple(r) for r in resample.generator_draws(spark, 1, 3, 0).collect()} == {(0, 0, 1), (1, 0, 1), (2, 0, 1)}


def test_draws_weigh_alike(spark):
    from gradus.sources.images import concentration_by, draw_spread

    df = spark.createDataFrame([("w", 1, 1.0), ("w", 1, 3.0), ("w", 2, 4.0), ("w", 2, None), ("v", 1, 5.0), (None, 1, None)], "w string, d int, x double")
    got = {r.w: tuple(r)[1:] for r in draw_spread(df, "w", "d", "x").collect()}
    assert got == {"w": (2, 3, 3.0, pytest.approx(math.sqrt(2)), 2.0, 4.0), "v": (1, 1, 5.0, None, 5.0, 5.0)}
    measured = df.select("w", F.col("x").alias("mass"), F.col("x").alias("area"), F.col("x").alias("ratio"))
    assert {(r.w, r.n, r.mass) for r in concentration_by(measured, "w").collect()} == {("w", 4, 8 / 3), ("v", 1, 5.0), (None, 1, None)}


@pytest.mark.parametrize(("least_corr", "most_mae"), [(0.995, 3.0), (0.9, 10.0), (0.3, 60.0), (1.0, 0.5)])
def test_similar_pairs_lose_none_in_cells(spark, least_corr, most_mae):
    rnd = np.random.default_rng(4)
    shapes = rnd.uniform(20, 200, (40, 16))
    images = [np.round(np.clip(shapes[i % 40] + rnd.normal(0, rnd.choice([0, 1, 4, 15]), 16) + rnd.choice([0, 2, 8]), 0, 255)) for i in range(160)] + [np.full(16, 7.0), np.full(16, 8.0), np.zeros(16)]
    rows = [("hk"[i % 3 == 0], i, x.tolist()) for i, x in enumerate(images)] + [("h", 500, images[1].tolist())]
    first = {}
    for b, i, x in rows:
        first.setdefault((b, tuple(x)), i)
    kept = [(b, i, np.array(x)) for (b, x), i in first.items()]
    want, all_pairs = set(), 0
    for b, i, x in kept:
        for c, k, y in kept:
            if b == c and i < k:
                all_pairs += 1
                if x.std() and y.std() and np.corrcoef(x, y)[0, 1] >= least_corr and np.abs(x - y).mean() <= most_mae:
                    want.add((i, k))
    df = spark.createDataFrame(rows, "b string, i int, x array<double>")
    got = quality.similar_pairs(df, "b", "i", "x", S.similarity, least_corr, most_mae).collect()
    assert len(got) == len(want) and {(r.left, r.right) for r in got} == want
    if least_corr > 0.9:
        assert quality.touching(df, "b", "i", "x", least_corr, most_mae).count() < all_pairs / 10


def test_leader_groups_of_many_heads(spark):
    rnd = np.random.default_rng(6)
    shapes = rnd.uniform(0, 200, (30, 12))
    images = [np.round(shapes[i % 30] + rnd.normal(0, 2, 12)) for i in range(200)] + [np.full(12, 3.0), np.full(12, 4.0)]
    df = spark.createDataFrame([("h", i, x.tolist()) for i, x in enumerate(images)], "b string, i int, x array<double>")
    heads, want = [], {}
    for i, x in enumerate(images):
        like = [h for h in heads if x.std() and images[h].std() and np.corrcoef(x, images[h])[0, 1] >= 0.99 and np.abs(x - images[h]).mean() <= 4]
        want[i] = like[0] if like else i
        if not like:
            heads.append(i)
    assert 16 < len(heads) < 100
    assert {r.i: r.head for r in quality.leader_groups(df, "b", "i", "x", 0.99, 4.0).collect()} == want


def _unpacked(packed, clusters):
    times = {}
    for r in packed.collect():
        for i, t in enumerate(r.times):
            at = (r.draw, r.block * resample.BLOCK + i)
            times[at] = times.get(at, 0) + t
    assert all(place < clusters for _, place in times)
    return {at: t for at, t in times.items() if t}


@pytest.mark.parametrize("size", [1, 11, 4096, 10001])
def test_packed_slots_are_the_slots(spark, size):
    clusters = spark.range(size).select(F.col("id").alias("place"), F.lit(size).cast("long").alias("clusters"))
    want = {(r.draw, r.place): r.times for r in resample.draws(clusters, 12).collect()}
    assert _unpacked(resample.packed_slots(spark, size, 12), size) == want
    assert resample.packed_slots(spark, 0, 12).collect() == []


@pytest.mark.parametrize("prefix", ["", "7:", "12:", "123:", "1999:", "x" * 49])
def test_heads_of_md5_are_those_of_the_library(prefix):
    """Numbers of one to eight digits in one piece or at its ends, and prefixes of every place in a word."""
    for a, b in [(0, 12001), (99990, 100000), (100000, 100003), (1299990, 1300000), (12345670, 12345689)]:
        if len(prefix) + len(str(b - 1)) <= 55:
            want = [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(a, b)]
            assert resample.md5_heads(prefix, a, b).tolist() == want
    for a, b in [(99999, 100001), (250000, 300001)]:
        with pytest.raises(ValueError):
            resample.md5_heads(prefix, a, b)


def test_counts_beyond_a_byte_are_kept():
    frame = next(iter(resample._packed(3, np.r_[np.zeros(600, np.uint32), np.full(2, 4097, np.uint32)], 5000)))
    first = [np.frombuffer(t, np.uint8)[0] for t, b in zip(frame["times"], frame["block"], strict=True) if b == 0]
    assert first == [255, 255, 90] and sum(frame["block"]) == 1 and set(frame["draw"]) == {3}


@pytest.mark.parametrize("size", [1, 11, 4096, 10001])
def test_two_places_share_a_byte(spark, size):
    clusters = spark.range(size).select(F.col("id").alias("place"), F.lit(size).cast("long").alias("clusters"))
    want = {(r.draw, r.place): r.times for r in resample.draws(clusters, 12).collect()}
    rows, got = resample.packed_slots(spark, size, 12, shared=True).collect(), {}
    assert {len(r.times) for r in rows} == {resample.BLOCK // 2} and len(rows) == 12 * -(-size // resample.BLOCK)
    for r in rows:
        got |= {(r.draw, r.block * resample.BLOCK + i): t for i, t in enumerate([t & 15 for t in r.times] + [t >> 4 for t in r.times]) if t}
    assert got == want


def test_counts_beyond_half_a_byte_are_kept():
    """A place with so many hits that a byte begins anew from zero, and one of the second half."""
    for n, rows in ((256, [15] * 17 + [1]), (20, [15, 5])):
        frame = next(iter(resample._packed(3, np.r_[np.zeros(n, np.intp), np.full(2, 4097)], 5000, shared=True)))
        assert [t[0] & 15 for t, b in zip(frame["times"], frame["block"], strict=True) if b == 0] == rows
    frame = next(iter(resample._packed(0, np.r_[np.full(17, 2049), np.full(2, 1)], 4096, shared=True)))
    assert [(t[1] & 15, t[1] >> 4) for t in frame["times"]] == [(2, 15), (0, 2)]


def test_draws_that_hit_one_cluster_often_are_weighed_whole(spark):
    clusters = spark.range(5000).select(F.col("id").alias("place"), F.col("id").alias("a"))
    hits = [[7] * 300 + [4500] * 16 + [2050], list(range(5000))]
    packed = spark.range(2).mapInPandas(lambda frames: (part for f in frames for d in f["id"] for part in resample._packed(int(d), np.array(hits[d]), 5000, shared=True)), "draw int, block long, times binary")
    assert dict(map(tuple, resample.weighed(clusters, ["a"], packed, 5000).collect())) == {i: sum(h) for i, h in enumerate(hits)}


def test_paired_report_reads_the_rows_of_both_arms_once(spark, tmp_path):
    """Beside the pass for the intervals, whose sums are kept; each arm's figures equal those over its own cells."""
    rows = spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") % 37).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.concat(F.col("id") % 5 + 1, F.lit("-X")).alias("o_orderpriority"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        report = reports.paired_report(spark, str(tmp_path))
        assert report._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        got = {r.metric: r for r in report.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for c, name in (("pred", "baseline"), ("cand", "candidate")):
        counted = metrics.cells(graded(preds(spark, str(tmp_path))), "diagnosis", c)
        assert got["qwk"][name] == metrics.qwk(counted, observed=True).first().qwk
        assert got["macro_f1"][name] == metrics.grade_metrics(counted).first().macro_f1
        assert got["sensitivity"][name] == metrics.referable_confusion(counted).first().sensitivity


def test_clusters_are_numbered_where_they_lie(spark):
    """Places in order of keys over all partitions, a missing key first, without another shuffle or sort of the rows."""
    keys = [None, *random.Random(5).sample(range(-(10**6), 10**6), 999)]
    numbered = resample.numbered(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int").repartition(5), "k")
    assert not re.search("Exchange|Window|Sort", numbered._jdf.queryExecution().executedPlan().toString())
    got = {r.place: (r.k, r.i, r.clusters) for r in numbered.collect()}
    want = sorted(((k, i, 1000) for i, k in enumerate(keys)), key=lambda r: -(10**7) if r[0] is None else r[0])
    assert [got[p] for p in range(1000)] == want
    assert resample.numbered(spark.createDataFrame([], "k long"), "k").collect() == []


def test_sums_of_draws_against_plain_sums(spark):
    rows = [(i, 5000, i % 7, i % 3 - 1, None if i == 9 else 0.5 * (i % 5)) for i in range(5000)]
    clusters = spark.createDataFrame(rows, "place long, clusters long, a int, b long, x double")
    want = resample.slots(clusters, 6).join(clusters, "place").groupBy("draw").agg(*[F.sum(c) for c in "abx"])
    got = resample.resampled(clusters, ["a", "b", "x"], 6)
    assert got.schema["a"].dataType == want.schema["sum(a)"].dataType
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("large", [1, 1 << 20, 1 << 40])
def test_whole_sums_are_exact_in_either_precision(spark, large):
    rows = [(i, 5000, large + i, -i) for i in range(5000)]
    clusters = spark.createDataFrame(rows, "place long, clusters long, a long, b long")
    want = resample.slots(clusters, 4).join(clusters, "place").groupBy("draw").agg(F.sum("a"), F.sum("b"))
    assert sorted(map(tuple, resample.resampled(clusters, ["a", "b"], 4).collect())) == sorted(map(tuple, want.collect()))


def test_a_task_weighs_a_few_blocks_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 16)
    clusters = spark.range(1600).select(F.col("id").alias("place"), F.lit(1600).cast("long").alias("clusters"), F.col("id").alias("a"))
    want = resample.slots(clusters, 3).join(clusters, "place").groupBy("draw").agg(F.sum("a"))
    for blocks, tasks in ((8, 12), (1, 100), (100, spark.sparkContext.defaultParallelism)):
        monkeypatch.setattr(resample, "BLOCKS", blocks)
        got = resample.resampled(clusters, ["a"], 3)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(rf"hashpartitioning\(block#\w+, {tasks}\), REPARTITION_BY_NUM", plan)) == 2
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_packed_generator_draws_are_the_generator_draws(spark):
    want = {}
    for r in resample.generator_draws(spark, 5000, 3, 7, 999).collect():
        want[r.draw, r.place] = want.get((r.draw, r.place), 0) + r.times
    assert _unpacked(resample.packed_generator_draws(spark, 5000, 3, 7, 999), 5000) == want


@pytest.mark.parametrize("held", [1, 256 << 20])
def test_auc_of_draws_over_blocks_with_odd_scores(spark, monkeypatch, held):
    """More than a block of clusters, several ranges, rows that count twice, scores without a number, an arm of one class."""
    monkeypatch.setattr(resample, "WEIGHED", 4)
    monkeypatch.setattr(resample, "BLOCK", 16)
    monkeypatch.setattr(resample, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(int(c), int(y), float(np.round(y + rng.normal(), 1)), arm) for c in range(40) for y in rng.integers(0, 2, 3) for arm in "ab"]
    rows += [(1, 1, float("nan"), "a"), (2, 0, None, "a"), (3, 1, 0.5, "a"), (3, 1, 0.5, "a"), (4, 0, 0.1, "c"), (5, None, 0.3, "c"), (None, 1, 0.2, "a")]
    df = spark.createDataFrame(rows, "c long, y int, s double, arm string")
    got = {(r.arm, r.draw): r.auc for r in resample.resampled_auc(df, "c", F.col("y") == 1, "s", "arm", 8).collect()}
    places = {r.c: r.place for r in resample.numbered(df.select("c").distinct(), "c").collect()}
    times = {(r.draw, r.place): r.times for r in resample.draws(resample.numbered(df.select("c").distinct(), "c"), 8).collect()}
    for (arm, draw), auc in got.items():
        key = lambda x: math.inf if x is None or x != x else x
        pos, neg = ([(key(r[2]), times.get((draw, places[r[0]]), 0)) for r in rows if r[3] == arm and r[1] == y and r[0] is not None] for y in (1, 0))
        wins = sum(a * b * ((x > z) + (x == z) / 2) for x, a in pos for z, b in neg)
        whole = sum(a for _, a in pos) * sum(b for _, b in neg)
        assert auc == (pytest.approx(wins / whole) if whole else None)
    assert len(got) == 24


def test_fold_means_add_in_order_of_folds(spark):
    raws = [0.1, 0.7, 1e16, -1e16, 0.3]
    rows = [(1, 2, f, raws[f]) for f in reversed(range(5))] + [(2, 0, 1, None), (2, 0, 0, 3.0), (3, None, 0, None)]
    df = spark.createDataFrame(rows, "i int, t int, fold int, raw double")
    assert {r.i: r.raw for r in audits.fold_means(df, "i", "t").collect()} == {1: ((((0.0 + 0.1) + 0.7) + 1e16) - 1e16 + 0.3) / 5, 2: 3.0, 3: None}
    graded = audits.sweep_metrics(df.where("i = 1").withColumn("t", F.lit(0)), spark.createDataFrame([(f, [0.2, 1.0, 2.0, 3.0]) for f in range(5)], "fold int, cuts array<double>"), "i", "t")
    assert graded.where("fold = 0").first().accuracy == 1.0


def test_similar_pairs_across_tiles(spark, monkeypatch):
    """Cells of many tiles, and images of other sizes; pairs go to a task by tiles, so none of them is a row that is joined."""
    monkeypatch.setattr(quality, "TILE", 8)
    rnd = np.random.default_rng(2)
    images = [rnd.uniform(0, 1, 9) for _ in range(90)] + [rnd.uniform(0, 1, 4) for _ in range(9)] + [np.full(9, 0.5)]
    df = spark.createDataFrame([("h", i, x.tolist()) for i, x in enumerate(images)], "b string, i int, x array<double>")
    want = {}
    for i, x in enumerate(images):
        for k, y in enumerate(images[:i]):
            if len(x) == len(y) and x.std() and y.std() and np.corrcoef(x, y)[0, 1] >= 0.3 and np.abs(x - y).mean() <= 0.25:
                want[k, i] = (pytest.approx(np.corrcoef(x, y)[0, 1]), pytest.approx(np.abs(x - y).mean()))
    pairs = quality.similar_pairs(df, "b", "i", "x", S.similarity, 0.3, 0.25)
    assert "FlatMapCoGroupsInPandas" in pairs._jdf.queryExecution().toString()
    got = pairs.collect()
    assert len(got) == len(want) > 100 and {(r.left, r.right): (r.corr, r.mae) for r in got} == want


def test_forest_rows_are_dealt_to_all_cores(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(300)], "x double, g int").coalesce(1)
    assert stats._vectors(df, ["x"], "g").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(stats, "SHARE", 10)
    dealt = stats._vectors(df, ["x"], "g")
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 30 and max(r["count"] for r in sizes) <= 20 and dealt.count() == 300
