"""Balanced folds, nested comparisons, stores that reuse results, histories by step."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradus.operators import nested, splits
from gradus.operators.checks import ContractError
from gradus.sources import stores
from gradus.streaming import history


def people(n=160, seed=3):
    """Groups whose classes go with their sizes, so that dealing by size and highest class leaves folds uneven."""
    rnd = random.Random(seed)
    rows = []
    for g in range(n):
        worst = rnd.choice([0, 0, 0, 1, 2, 3, 4])
        rows += [(f"g{g}", rnd.choice([0, worst, worst])) for _ in range(rnd.randint(1, 4 + 2 * worst))]
    return rows


def deviation(rows):
    """The mean over classes of how far the folds' shares of a class are from a fifth."""
    total, per = Counter(y for _, y, _ in rows), Counter((f, y) for _, y, f in rows)
    return sum(abs(per[f, y] / total[y] - 0.2) for f in range(1, 6) for y in total)


@pytest.mark.parametrize("vectors", [1 << 16, 20])
def test_balanced_folds_keep_groups_and_class_shares(spark, vectors):
    df = spark.createDataFrame(people(), "g string, y int")
    dealt = splits.balanced_group_folds(df, "g", "y", 5, vectors=vectors)
    rows = [(r.g, r.y, r.fold) for r in dealt.collect()]
    assert len(rows) == df.count() and {f for *_, f in rows} == {1, 2, 3, 4, 5}
    of = defaultdict(set)
    for g, _, f in rows:
        of[g].add(f)
    assert all(len(f) == 1 for f in of.values())
    plain = [(r.g, r.y, r.fold) for r in splits.group_folds(df, "g", "y", 5).collect()]
    assert deviation(rows) < 0.5 * deviation(plain)
    again = splits.balanced_group_folds(df.orderBy(F.rand(1)), "g", "y", 5, vectors=vectors).select("g", "fold").distinct().collect()
    assert {(r.g, r.fold) for r in again} == {(g, next(iter(f))) for g, f in of.items()}


def test_balanced_folds_of_nothing_and_of_null_groups(spark):
    assert splits.balanced_group_folds(spark.createDataFrame([], "g string, y int"), "g", "y", 5).collect() == []
    got = splits.balanced_group_folds(spark.createDataFrame([(None, 1), ("a", 2)], "g string, y int"), "g", "y", 5).collect()
    assert {(r.g, r.fold) for r in got} == {(None, None), ("a", 1)}


def test_balanced_nested_split(spark):
    rows = splits.nested_split(spark.createDataFrame(people(), "g string, y int"), "g", "y", balanced=True).collect()
    assert all(len({r.part for r in rows if r.g == g}) == 1 for g in {r.g for r in rows})
    ill = {p: sum(r.y >= 2 for r in rows if r.part == p) / sum(r.part == p for r in rows) for p in splits.PARTS}
    assert max(ill.values()) - min(ill.values()) < 0.04


A = '{"a": 1, "b": {"c": [1, 2, {"d": "x"}], "e f": null}, "t": true, "o": {}, "same": [[]]}'
B = '{"a": 1.00000000001, "b": {"c": [1, 2.5, {"d": "y"}, 4], "e f": 0}, "t": "true", "same": [[]], "new": {"k": -1e300}}'


def test_nested_reports_differ_where_they_differ(spark):
    a = spark.createDataFrame([(1, A), (2, "[1]"), (3, None), (4, "5")], "id int, doc string")
    b = spark.createDataFrame([(1, B), (3, None), (4, "5")], "id int, doc string")
    got = {(r.id, r.path, r.change, r.recorded, r.found) for r in nested.compare_reports(a, b, "id", "doc").collect()}
    assert got == {
        (1, "$.b.c", "length", 3.0, 4.0), (1, "$.b.c[1]", "number", 2.0, 2.5), (1, "$.b.c[2].d", "text", None, None), (1, "$.b.c[3]", "added", None, 4.0),
        (1, '$.b."e f"', "kind", None, 0.0), (1, "$.t", "kind", None, None), (1, "$.o", "missing", None, None), (1, "$.new", "added", None, None),
        (1, "$.new.k", "added", None, -1e300), (2, "$", "missing", 1.0, None), (2, "$[0]", "missing", 1.0, None),
    }
    assert nested.compare_reports(a, a, "id", "doc").collect() == []
    with pytest.raises(Exception, match="MALFORMED"):
        nested.json_nodes(spark.createDataFrame([(1, "{no json")], "id int, doc string"), "id", "doc").collect()


def test_deep_reports_are_opened_to_the_end(spark):
    deep = "1"
    for _ in range(12):
        deep = f'{{"x": [{deep}]}}'
    paths = {r.path for r in nested.json_nodes(spark.createDataFrame([(1, deep)], "id int, doc string"), "id", "doc").collect()}
    assert len(paths) == 25 and "$" + ".x[0]" * 12 in paths


def test_settings_must_agree(spark):
    schema = "id int, l map<string,string>, r map<string,string>"
    rows = [(1, {"a": "1", "b": "2", "n.x": "3", "z": None}, {"a": "1", "b": "3", "c": "4", "z": None}), (2, None, {"a": "1"}), (3, {"b": "1"}, {"b": "1"}), (4, {"b": None}, {"b": "1"})]
    got = {tuple(r) for r in nested.compare_settings(spark.createDataFrame(rows, schema), "id", "l", "r", ["n."], ["b"]).collect()}
    assert got == {(1, "b", "2", "3", "differs"), (1, "c", None, "4", "only_right"), (2, "a", None, "1", "only_right"), (2, "b", None, None, "absent"), (4, "b", None, "1", "differs")}


def lengths(seen):
    def compute(df):
        rows = df.select("k", F.length("text").cast("long").alias("n"))
        seen.append(sorted(r.k for r in rows.collect()))
        return rows

    return compute


def test_a_second_run_computes_what_is_new(spark, tmp_path):
    path, seen = str(tmp_path / "store"), []
    frame = lambda rows: spark.createDataFrame(rows, "k int, text string")
    found = lambda r: sorted(map(tuple, r.results.select("k", "n", "reused").collect()))
    rows = [(i, "x" * i) for i in range(50)]
    first = stores.refresh(frame(rows), path, "k", {"v": 1}, lengths(seen), buckets=8)
    assert first.counts == {"added": 50} and found(first) == [(i, i, False) for i in range(50)]
    later = [(i, "x" * i + "y" * (i == 7)) for i in range(5, 50)] + [(100, None)]
    second = stores.refresh(frame(later), path, "k", {"v": 1}, lengths(seen), buckets=8)
    assert second.counts == {"missing": 5, "changed": 1, "added": 1, "same": 44} and second.computed == 2 and seen[-1] == [7, 100]
    assert found(second) == sorted([(i, i + (i == 7), i != 7) for i in range(5, 50)] + [(100, None, False)], key=lambda r: r[0])
    third = stores.refresh(frame(later), path, "k", {"v": 1}, lengths(seen), buckets=8)
    assert third.counts == {"same": 46} and len(seen) == 2 and {r[2] for r in found(third)} == {True}
    other = stores.refresh(frame(later), path, "k", {"v": 2}, lengths(seen), buckets=8)
    assert other.counts == {"changed": 46} and len(seen[-1]) == 46
    gone = stores.refresh(frame([]), path, "k", {"v": 2}, lengths(seen), buckets=8)
    assert gone.counts == {"missing": 46} and found(gone) == [] and spark.read.parquet(f"{path}/rows").where("k is not null").count() == 0
    with pytest.raises(ContractError):
        stores.refresh(frame([(1, "a"), (1, "b")]), path, "k", {}, lengths(seen))
    assert stores.refresh(frame([]), str(tmp_path / "new"), "k", {}, lengths(seen)).results.collect() == []


def test_damaged_and_half_replaced_results_are_computed_anew(spark, tmp_path):
    path, seen = str(tmp_path / "store"), []
    rows = spark.createDataFrame([(i, "x" * i) for i in range(40)], "k int, text string")
    stores.refresh(rows, path, "k", {}, lengths(seen), buckets=4)
    stored = spark.read.parquet(f"{path}/rows")
    damaged = stored.withColumn("n", F.when(F.col("k") == 3, -1).otherwise(F.col("n"))).where("bucket = 0 OR k = 3 OR k IS NULL").collect()
    spark.createDataFrame(damaged, stored.schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    again = stores.refresh(rows, path, "k", {}, lengths(seen), buckets=4)
    assert 3 in seen[-1] and again.computed == len(seen[-1]) < 40
    assert sorted((r.k, r.n) for r in again.results.collect()) == [(i, i) for i in range(40)]


def test_history_keeps_the_last_write(spark, tmp_path):
    rnd, schema = random.Random(1), "run string, metric string, step int, value double, at int"
    rows = [(rnd.choice("ab"), rnd.choice("mn"), rnd.randint(0, 5), rnd.random(), at) for at in range(300)]
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def want(n):
        last = {}
        for row in rows[:n]:
            last[row[:3]] = row
        return sorted(last.values())

    for n in (100, 200, 300):
        spark.createDataFrame(rows[n - 100 : n], schema).coalesce(2).write.mode("append").parquet(source)
        history.log_metrics(stream(), store, checkpoint, ["at"])
        assert sorted(map(tuple, history.metric_history(spark, store, ["at"]).collect())) == want(n)
    batches = spark.read.parquet(store).select("batch").distinct().count()
    history.log_metrics(stream(), store, checkpoint, ["at"])  # nothing is new
    assert spark.read.parquet(store).select("batch").distinct().count() == batches > 1
    # A checkpoint that lost its last commit replays that batch over itself.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    before = spark.read.parquet(store).count()
    history.log_metrics(stream(), store, checkpoint, ["at"])
    assert spark.read.parquet(store).count() == before and sorted(map(tuple, history.metric_history(spark, store, ["at"]).collect())) == want(300)
    history.compact(spark, store, str(tmp_path / "compacted"), ["at"])
    assert sorted(map(tuple, history.metric_history(spark, str(tmp_path / "compacted"), ["at"]).collect())) == want(300)
