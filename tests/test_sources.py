import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators.checks import ContractError
from gradus.sources import images, labels, sinks


def put(tmp_path, text, name="t.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


HEAD = "id_code,diagnosis,split,is_referable\n"
GOOD = HEAD + "a,0,train,False\nb,2,valid,True\nc,4,test,True\n"


def test_inspect_counts_and_rejects(spark, tmp_path):
    rows = {r.split: r for r in labels.inspect_labels(spark, put(tmp_path, "﻿" + GOOD), 3).collect()}
    assert rows["train"].grade_0 == 1 and rows["test"].grade_4 == 1
    for i, bad in enumerate(["a,5,test,True", "d,2.0,test,True", "a,2,test,True", "d,2,holdout,True", "d,2,test,False", " ,2,test,True"]):
        with pytest.raises(ContractError):
            labels.inspect_labels(spark, put(tmp_path, GOOD + bad + "\n", f"bad{i}.csv")).collect()
    with pytest.raises(ContractError):
        labels.inspect_labels(spark, put(tmp_path, GOOD, "n.csv"), 4)


def test_load_labels_and_raw(spark, tmp_path):
    assert labels.load_labels(spark, put(tmp_path, GOOD)).count() == 3
    raw = labels.load_raw_labels(spark, put(tmp_path, "id_code,diagnosis\n a ,3\nb,\n", "raw.csv"), "train").collect()
    assert [(r.id_code, r.diagnosis_label, r.is_referable, r.image_uri) for r in raw] == [("a", "Severe", True, "images/train/a.png")]


def test_pairs_and_paired(spark, tmp_path):
    assert [tuple(r) for r in labels.read_pairs(spark, put(tmp_path, "left;right \na.png;b.png\n", "p.csv")).collect()] == [("a", "b")]
    with pytest.raises(ContractError):
        labels.read_pairs(spark, put(tmp_path, "left;right\na.png;b.png\nb.png;c.png\n", "q.csv"))
    head = "id_code,diagnosis,baseline_grade,candidate_grade,patient_id\n"
    assert labels.read_paired(spark, put(tmp_path, head + "a,1,2,3,p\nb,0,0,0,p\n", "r.csv"), "patient_id").count() == 2
    with pytest.raises(ContractError):
        labels.read_paired(spark, put(tmp_path, head + "a,1,2,3,nan\n", "s.csv"), "patient_id")


def refused(spark, key, grade):
    rows = spark.createDataFrame([("plain", "3"), (key, grade)], "id_code string, diagnosis string")
    with pytest.raises(ContractError):
        labels.validate_external(rows)


def test_external_grades_outside_the_scale_are_refused(spark):
    rnd = random.Random(3)
    whole = [n for n in (*range(-9, 0), *range(5, 15))]
    for grade in (rnd.choice(whole), rnd.randrange(4) + rnd.choice([0.25, 0.5, 0.75]), float("-inf"), float("nan"), "".join(rnd.choices(string.ascii_letters, k=6))):
        refused(spark, "other", str(grade))


def test_external_ids_that_are_no_file_names_are_refused(spark):
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choices(string.ascii_lowercase, k=5))
    for mark in "/\\\0":
        refused(spark, name() + mark + name(), "1")
    for key in (name() + " ", " " * 3 + name(), "." * rnd.randint(1, 2), ""):
        refused(spark, key, "1")


def test_external_keeps_padding_out(spark, tmp_path):
    got = labels.load_cohort(spark, put(tmp_path, "name,g,ok\na.jpg,2.0,1\nb.jpg,3,0\n,,\n", "c.csv"), "name", "g", "ok")
    assert [tuple(r) for r in got.collect()] == [("a", 2)]


def test_fold_arrays(spark):
    folds = spark.createDataFrame([("s", 1, ["a", "b"], [0, 2], [0.0, 2.0]), ("s", 2, ["b", "a"], [2, 0], [3.0, 1.0])], "sweep string, fold int, test_ids array<string>, test_true array<int>, test_raw array<double>")
    rows = labels.explode_folds(folds)
    assert {r.id_code: r.raw for r in labels.ensemble(rows, 2).collect()} == {"a": 0.5, "b": 2.5}
    with pytest.raises(ContractError):
        labels.ensemble(rows.where("not (fold = 2 and id_code = 'a')"), 2)


def disc(h=60, w=90, radius=25):
    y, x = np.mgrid[:h, :w]
    inside = (y - h / 2) ** 2 + (x - w / 2) ** 2 <= radius**2
    out = np.zeros((h, w, 3), np.uint8)
    out[inside] = [40, 80, 160]
    return out


def test_pixel_operators():
    image = disc()
    assert images.auto_crop(image).shape[:2] == (51, 51)
    assert images.pad_to_square(image).shape == (90, 90, 3)
    blocks = np.random.default_rng(0).permutation(72).reshape(8, 9, 1).astype(np.uint8) * 3
    assert images.difference_hash(blocks) == images.difference_hash(np.repeat(np.repeat(blocks, 5, 0), 5, 1))
    assert np.allclose(images.area_resize(np.arange(12.0).reshape(3, 4), 1, 2), [[4.5, 6.5]])
    assert images.auto_crop(np.zeros((4, 5, 3), np.uint8)).shape == (4, 5, 3)


def test_image_scan_keeps_unreadable_files(spark, tmp_path):
    import struct
    import zlib

    image = disc()[:, :, ::-1]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 90, 60, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "good.png").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = {r.origin.rpartition("/")[2]: r for r in images.image_stats(spark, str(tmp_path)).collect()}
    assert not rows["bad.png"].readable and rows["bad.png"].width is None
    good = rows["good.png"]
    assert (good.width, good.height, good.crop_width, good.color_mode) == (90, 60, 51, "color") and good.dhash == images.difference_hash(disc())
    assert images.file_hashes(spark, str(tmp_path), "*.png").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", 0.1234567, "b"), ("r2", float("nan"), None)], "run_name string, m double, v string")
    path = str(tmp_path / "runs")
    sinks.append_runs(df, path)
    sinks.append_runs(df, path)
    assert spark.read.parquet(path).count() == 2
    out = sinks.export_runs(df, ["m"], ["v"]).collect()
    assert out[0].m == 0.123457 and out[1].m is None
    assert "N/A" in sinks.to_markdown(df)
    with pytest.raises(ContractError):
        sinks.write_new(df, path)
    sinks.write_labels(df.withColumn("split", F.lit("test")).withColumn("id_code", F.col("run_name")), str(tmp_path / "labels"))
    assert sinks.run_id({"a": 1, "b": 2}, "x") == sinks.run_id({"b": 2, "a": 1}, "x")


def test_reports_by_table_name(spark):
    from gradus.plans import sqlapi

    spark.createDataFrame([("a", 0, "train", False), ("b", 7, "valid", True), ("b", 2, "test", False), (" ", 1, "none", None)], "id_code string, diagnosis int, split string, is_referable boolean").createOrReplaceTempView("some_labels")
    row = sqlapi.run(spark, "label_integrity", "some_labels").first().asDict()
    assert row == {"label_rows": 4, "distinct_ids": 3, "missing_ids": 1, "invalid_grades": 1, "invalid_splits": 1, "invalid_referral_flags": 2}
    assert "sizeInBytes" in sqlapi.estimate(spark, "referral_prevalence", "some_labels")
    with pytest.raises(ValueError):
        sqlapi.run(spark, "label_integrity", "labels; DROP TABLE x")


def png(path, image):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in image[:, :, ::-1])
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_prepared_images_have_a_reason_or_pixels(spark, tmp_path):
    png(tmp_path / "good.png", disc())
    png(tmp_path / "dark.png", np.zeros((9, 9, 3), np.uint8))
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = {r.origin.rpartition("/")[2]: r for r in images.prepared(spark, str(tmp_path), 16, "pad").collect()}
    assert (rows["bad.png"].error, rows["dark.png"].error, rows["good.png"].error) == ("unreadable", "too dark", None)
    assert len(rows["good.png"].image) == 16 * 16 * 3 and rows["dark.png"].image is None
    thumbs = {r.origin.rpartition("/")[2]: r.thumb for r in images.thumbnails(spark, str(tmp_path), 8).collect()}
    assert len(thumbs["good.png"]) == 64 and thumbs["bad.png"] is None
    wide = np.repeat(np.arange(8, dtype=np.uint8)[None, :, None] * 30, 4, 0)
    assert images.to_square(wide, 4, "squash")[0, :, 0].tolist() == [15, 75, 135, 195] and images.to_square(wide, 8, "pad")[0].max() == 0
    with pytest.raises(ValueError):
        images.to_square(wide, 4, "crop")


def test_heat_on_tissue(spark):
    rows = spark.createDataFrame([([3.0, 1.0], [20.0, 0.0]), ([0.0, 0.0], [20.0, 0.0]), ([1.0, 1.0], [20.0, 20.0])], "h array<double>, v array<double>")
    got = [r[0] for r in rows.select(images.concentration(F.col("h"), F.col("v"))).collect()]
    assert tuple(got[0]) == (0.75, 0.5, 1.5) and got[1].mass is None and got[2].ratio is None and got[2].area == 1.0


def test_fold_archives_open_only_what_is_asked_for(spark, tmp_path):
    rng, want = np.random.default_rng(1), []
    for sweep in ("s", "t"):
        (tmp_path / sweep).mkdir()
        for fold in (1, 2, 3):
            ids, truth, raw = np.array([f"{sweep}{k}" for k in range(4)]), rng.integers(0, 5, 4), rng.random(4)
            np.savez(tmp_path / sweep / f"fold{fold}.npz", test_ids=ids, test_true=truth, test_raw=raw)
            want += [(sweep, fold, k, str(ids[k]), int(truth[k]), float(raw[k])) for k in range(4)]
    (tmp_path / "s" / "notes.txt").write_text("no archive")
    assert sorted(map(tuple, labels.read_fold_archives(spark, str(tmp_path)).collect())) == want
    folds = spark.createDataFrame([(s, f, [r[3] for r in want if r[:2] == (s, f)], [r[4] for r in want if r[:2] == (s, f)], [r[5] for r in want if r[:2] == (s, f)]) for s in "st" for f in (1, 2, 3)], "sweep string, fold int, test_ids array<string>, test_true array<int>, test_raw array<double>")
    assert sorted(map(tuple, labels.explode_folds(folds).collect())) == want
    # Every other archive is broken: reading any of them would fail.
    for fold in (1, 3):
        (tmp_path / "s" / f"fold{fold}.npz").write_bytes(b"broken")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = labels.read_fold_archives(spark, str(tmp_path)).where("fold = 2 AND sweep IN ('s')")
        assert found.rdd.getNumPartitions() == 1 and sorted(map(tuple, found.collect())) == [r for r in want if r[:2] == ("s", 2)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_archives_of_uneven_arrays_raise(spark, tmp_path):
    (tmp_path / "s").mkdir()
    np.savez(tmp_path / "s" / "fold1.npz", test_ids=np.array(["a", "b"]), test_true=np.array([0]), test_raw=np.array([0.5, 1.5]))
    with pytest.raises(Exception, match="same length|expected length"):
        labels.read_fold_archives(spark, str(tmp_path)).collect()


def test_graded_ensemble_averages_first(spark):
    rows = spark.createDataFrame([("s", f, k, i, 1, r) for f, rs in ((1, (0.4, 1.4)), (2, (0.8, 1.8))) for k, (i, r) in enumerate(zip("ab", rs, strict=True))], "sweep string, fold int, pos int, id_code string, test_true int, test_raw double")
    cuts = spark.createDataFrame([("s", 1, [0.4, 1.5, 2.5, 3.5]), ("s", 2, [0.8, 1.9, 2.5, 3.5])], "sweep string, fold int, cuts array<double>")
    got = {r.id_code: (round(r.raw, 6), r.pred) for r in labels.graded_ensemble(rows, cuts, 2, in_order=True).collect()}
    assert got == {"a": (0.6, 1), "b": (1.6, 1)}
    with pytest.raises(ContractError):
        labels.graded_ensemble(rows.withColumn("pos", F.col("pos") * F.col("fold")), cuts, 2, in_order=True)
    with pytest.raises(ContractError):
        labels.graded_ensemble(rows, cuts.withColumn("cuts", F.reverse("cuts")), 2)


def test_strict_ids_patients_and_files(spark, tmp_path):
    head = "id_code,diagnosis\n"
    assert {tuple(r) for r in labels.read_ids(spark, put(tmp_path, head + "a,3\nb,1.00\n")).collect()} == {("a", 3), ("b", 1)}
    for k, bad in enumerate(("c,1.5", "c,05", "c,", "a,1")):
        with pytest.raises(ContractError):
            labels.read_ids(spark, put(tmp_path, head + "a,3\n" + bad + "\n", f"ids{k}.csv"))
    assert labels.read_patients(spark, put(tmp_path, "id_code,patient_id\na,p\nb,p\n", "p.csv")).count() == 2
    with pytest.raises(ContractError):
        labels.read_patients(spark, put(tmp_path, "id_code,patient_id\na,p\nb, \n", "q.csv"))
    (tmp_path / "img" / "x").mkdir(parents=True)
    for name in ("a.png", "b.png", "x/b.png"):
        (tmp_path / "img" / name).write_bytes(b"1")
    wanted = spark.createDataFrame([("a",)], "id_code string")
    assert labels.find_files(spark, str(tmp_path / "img"), wanted).count() == 1
    for key in "bc":
        with pytest.raises(ContractError):
            labels.find_files(spark, str(tmp_path / "img"), wanted.union(spark.createDataFrame([(key,)], "id_code string")))


def test_tables_runs_and_reports(spark, tmp_path):
    rows = labels.load_labels(spark, put(tmp_path, GOOD))
    sinks.save_table(rows, "kept_labels", 2, "id_code", ["id_code"])
    assert labels.load_labels(spark, "kept_labels", "table").count() == 3 and labels.read_runs(spark, "kept_labels", "none").count() == 3
    assert labels.read_runs(spark, "no_such_table", put(tmp_path, "run,m\nr1,0.5\n", "runs.csv")).first().m == 0.5
    (tmp_path / "r.json").write_text('{"set": "one",\n "n": 3}')
    assert tuple(labels.read_report(spark, str(tmp_path / "r.json"), "set string, n int").first()) == ("one", 3)
    spark.sql("DROP TABLE kept_labels")


def test_published_results_are_whole(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.createDataFrame([("a", 0.5), ("b", float("nan"))], "id_code string, raw double")
    with pytest.raises(ContractError):
        sinks.read_published(spark, path)
    sinks.publish(rows, path, {"model": "m"})
    assert sinks.read_published(spark, path).count() == 2
    with pytest.raises(ContractError, match="exists"):
        sinks.publish(rows, path, {"model": "m"})
    assert sinks.read_published(spark, path).count() == 2
    rows.limit(1).write.mode("append").parquet(f"{path}/scores")
    with pytest.raises(ContractError):
        sinks.read_published(spark, path)
    with pytest.raises(ValueError):
        sinks.strict_json({"a": float("inf")})
    assert [r.value for r in sinks.as_json(rows).orderBy("value").collect()] == ['{"id_code":"a","raw":0.5}', '{"id_code":"b","raw":null}']


def test_a_failed_publication_leaves_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "out"), spark.range(300, numPartitions=3).select(F.col("id").cast("string").alias("id_code"), (F.col("id") / 3).alias("raw"))
    broken = rows.withColumn("raw", F.when(F.col("id_code") == "250", F.raise_error(F.lit("a task fails"))).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="a task fails"):
        sinks.publish(broken, path, {})
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError):
        sinks.publish(rows, path, {"mean": float("nan")})
    assert list(tmp_path.iterdir()) == []
    (tmp_path / "elsewhere").write_text("")  # the commit's rename fails
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish(rows, str(tmp_path / "elsewhere" / "out"), {})
    sinks.publish(rows, path, {"model": "m"})
    assert {p.name for p in tmp_path.iterdir()} == {"elsewhere", "out"} and sinks.read_published(spark, path).count() == 300
    part = next((tmp_path / "out" / "scores").iterdir())
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    with pytest.raises(ContractError, match="changed"):
        sinks.read_published(spark, path)


def test_an_empty_publication_keeps_its_columns(spark, tmp_path):
    rows = spark.createDataFrame([], "id_code string, raw double")
    sinks.publish(rows, str(tmp_path / "none"), {})
    found = sinks.read_published(spark, str(tmp_path / "none"))
    assert found.dtypes == rows.dtypes and found.count() == 0


def test_lines_with_other_numbers_of_fields_are_named(spark, tmp_path):
    text = 'id_code,diagnosis,split\na,0,train\nb,1,valid,extra\n\n"c,x",2,test\nd,3\ne,"4,test\n'
    path = put(tmp_path, text, "broken.csv")
    assert [(r.line, r.record) for r in labels.broken_lines(spark, path).orderBy("line").collect()] == [(3, "b,1,valid,extra"), (6, "d,3"), (7, 'e,"4,test')]
    with pytest.raises(ContractError, match="broken.csv:3: b,1,valid,extra"):
        labels.inspect_labels(spark, path)
    without = put(tmp_path, "id_code,diagnosis,split\na,0,train\nb,4,test\n", "plain.csv")
    assert {(r.split, r.n) for r in labels.inspect_labels(spark, without).collect()} == {("train", 1), ("test", 1)}
    many = put(tmp_path, "id_code,diagnosis,split\n" + "".join(f"x{i},{i % 5},train{',more' * (i % 997 == 5)}\n" for i in range(20_000)), "many.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert [r.line for r in labels.broken_lines(spark, many).orderBy("line").collect()] == [i + 2 for i in range(5, 20_000, 997)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_folds_runs_and_lists_are_stored(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 0, 0.1)], "id_code string, test_true int, test_raw double")
    path = str(tmp_path / "folds")
    for fold in (1, 2):
        sinks.write_fold(rows, path, "s", fold)
    with pytest.raises(ContractError):
        sinks.write_fold(rows, path, "s", 2)
    with pytest.raises(ContractError):
        sinks.write_fold(rows.union(rows), path, "s", 3)
    assert sinks.read_folds(spark, path).where("fold = 2").count() == 2
    sinks.write_run(rows, str(tmp_path / "run"), {"b": 1, "a": 2})
    assert spark.read.text(str(tmp_path / "run" / "config")).first().value == '{"a": 2, "b": 1}'
    sinks.write_findings(rows, rows.limit(0), str(tmp_path / "lists"))
    assert spark.read.option("header", True).csv(str(tmp_path / "lists" / "problems")).count() == 2
    split = rows.withColumn("split", F.lit("test"))
    sinks.write_combined(split, str(tmp_path / "labels"))
    sinks.write_image_stats(split, str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "labels" / "by_split")).count() == spark.read.parquet(str(tmp_path / "labels" / "all")).count() == 2
    commits = spark.createDataFrame([("old", "new")], "old string, new string")
    renamed = sinks.export_runs(spark.createDataFrame([("old", 1.0), ("x", 2.0)], "commit string, m double"), ["m"], ["m"], commits)
    assert [r.commit for r in renamed.collect()] == ["new", "x"]


def test_comparison_of_published_results(spark, tmp_path):
    schema = "id_code string, diagnosis int, raw double"
    for name, rows in (("a", [("x", 1, 0.5), ("y", 3, 2.0)]), ("b", [("x", 1, 0.7), ("y", 3, 2.5)]), ("c", [("x", 1, 0.7)]), ("d", [("x", 2, 0.7), ("y", 3, 2.5)])):
        sinks.publish(spark.createDataFrame(rows, schema), str(tmp_path / name), {"model": name})
    got = sinks.comparison_frame(spark, str(tmp_path / "a"), str(tmp_path / "b")).orderBy("id_code").collect()
    assert [tuple(r) for r in got] == [("x", 1, 0.5, 0.7), ("y", 3, 2.0, 2.5)]
    for other in "cd":
        with pytest.raises(ContractError):
            sinks.comparison_frame(spark, str(tmp_path / "a"), str(tmp_path / other))


def test_caches_are_held_against_settings_and_counts(spark, tmp_path, capsys):
    from gradus.sources import caches

    made = {"size": 64, "clahe": True, "clip_limit": 2.0, "square_mode": "pad", "workers": 8}
    for name, settings, recorded, there in (
        ("good one+%", made, 3, 3), ("interrupted", made, 5, 2), ("emptied", made, 1, 0), ("other size", made | {"size": 32, "square_mode": "crop"}, 1, 1), ("bare", {"size": 64}, 1, 1),
    ):
        caches.write_manifest(str(tmp_path / name), settings, recorded)
        for i in range(there):
            folder = tmp_path / name / ("train" if i else "")
            folder.mkdir(exist_ok=True)
            put(folder, "x", f"{i}.jpg")
        put(tmp_path / name, "x", "note.txt")
    (tmp_path / "unsaid").mkdir()
    (tmp_path / "broken").mkdir()
    put(tmp_path / "broken", "{", "_manifest.json")
    put(tmp_path, "x", "stray.jpg")
    path = str(tmp_path)
    expected = made | {"clip_limit": 2}
    got = {tuple(r) for r in caches.cache_findings(spark, path, expected).collect()}
    assert got == {
        ("interrupted", "n_images", "5", "2", "count"), ("emptied", "n_images", "1", "0", "count"), ("other size", "size", "32", "64", "differs"), ("other size", "square_mode", '"crop"', '"pad"', "differs"),
        ("bare", "clahe", "null", "true", "differs"), ("bare", "clip_limit", "null", "2", "differs"), ("bare", "square_mode", "null", '"pad"', "differs"),
        ("unsaid", None, None, None, "unrecorded"), ("broken", None, None, None, "unreadable"),
    }
    assert {r.cache for r in caches.cache_findings(spark, path, {}).collect()} == {"interrupted", "emptied", "unsaid", "broken"}
    with pytest.raises(ContractError, match="interrupted"):
        caches.require_caches(spark, path, {})
    caches.image_counts(spark, path).explain()
    assert "content" not in capsys.readouterr().out
    lines = {r.cache: r.line for r in caches.read_manifests(spark, path).select("cache", caches.describe(F.col("settings")).alias("line")).collect()}
    assert lines["good one+%"] == "64px, CLAHE clip=2, square=pad, n=3" and lines["bare"] == "64px, no CLAHE, square=?, n=1"


def test_repeated_ids_come_in_order(spark):
    from gradus.plans import sqlapi

    rows = [(i, 0, s, False) for i, splits in (("b", ["train", "test"]), ("a", ["train", "valid"]), ("c", ["train", "valid", "test"]), ("d", ["test", "test"])) for s in splits]
    spark.createDataFrame(rows, "id_code string, diagnosis int, split string, is_referable boolean").createOrReplaceTempView("repeated_labels")
    assert [r.id_code for r in sqlapi.run(spark, "repeated_id_across_splits", "repeated_labels").collect()] == ["c", "a", "b"]
