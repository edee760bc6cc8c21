import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gradus.llm import warc

PAGES = "page_id long, url string, html string, digest string, archive long, position long, stamp long"


def brute(rows):
    """(page, bytes, digest, type, refers_to) by row, and the key."""
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        head = first.get(html)
        later = head is not None and (page is None or page > head)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", head if later else None, warc.url_key(url)))
    return out


def sample():
    rnd = random.Random(4)
    long = ["x" * 100, "é" * 50, "y" * 5000, "<p>" + "z" * 97]
    rows = []
    for i in rnd.sample(range(1000), 150):
        html = rnd.choice([*long, "short", "x" * 99, "own %d " % i * 30])
        rows.append((i, f"http{rnd.choice(['', 's'])}://{rnd.choice(['A.Example.com', 'example.com', 'b.net'])}/{rnd.choice(['', 'p', 'é?q=1#f'])}", html))
    rows += [(2000, None, None), (2001, "", ""), (2002, "no scheme", "x" * 100), (None, "http://a.b/", "x" * 100), (None, None, "only null ids " * 20), (2003, "http://a\r\nb c/\x00", "y" * 5000), rows[0], rows[0]]
    return rows + [(2004, "://", "WARC/1.1\r\n\r\n" * 20), (2005, "http://long/", "long text\r\n" * 300_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, 3) for r in rows], PAGES)


def test_round_trip_against_brute_force(spark):
    rows = sample()
    got = [tuple(r) for r in warc.round_trip(frame(spark, rows).repartition(3)).collect()]
    assert sorted((r[:6] for r in got), key=str) == sorted(brute(rows), key=str)
    assert sorted(r[6] for r in got) == list(range(len(rows)))
    in_order = [(r[5], (r[0] or 0) % (1 << 32), r[0] is not None, r[0] or 0) for r in sorted(got, key=lambda r: r[6])]
    assert in_order == sorted(in_order)


def test_small_segments_runs_and_fan_in(spark):
    rows = sample()
    pages = frame(spark, rows).repartition(4)
    archives = warc.written(warc.write_archives(warc.decided(pages, F.timestamp_seconds(F.col("page_id") % 7)), segment_bytes=2000, run_captures=5, block=2), "archives")
    runs = archives.where("run is not null").select("run", "captures")
    assert runs.select("run").distinct().count() > 30 and runs.select(F.max(F.size("captures"))).first()[0] == 2
    index = warc.merged_index(runs, fan_in=3, block=2)
    found = index.orderBy("position").collect()
    key = lambda r: (r.url_key, r.stamp, r.page_id is not None, r.page_id or 0, r.archive, r.segment, r.offset)
    assert [r.position for r in found] == list(range(len(rows))) and [key(r) for r in found] == sorted(map(key, found))
    assert {r.stamp for r in found} == {0, 1, 2, 3, 4, 5, 6}
    got = warc.read_back(archives, index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url_key) for r in got), key=str) == sorted(brute(rows), key=str)


def test_exported_files_are_plain_archives(spark, tmp_path):
    rows = sample()
    archives = warc.written(warc.write_archives(warc.decided(frame(spark, rows), warc.by_id()).repartition(3), segment_bytes=5000), "archives")
    files = warc.export_archives(archives, f"file://{tmp_path}/warc").collect()
    assert len(files) == 3 and len(list((tmp_path / "warc").iterdir())) == 3
    got = []
    for path, size in files:
        data = open(path, "rb").read()
        assert len(data) == size and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        for member in warc.members(data):
            fields, block = warc.parse(member)
            assert fields["warc-date"].endswith("Z") and not set("\r\n\x00 ") & set(fields["warc-target-uri"]) and block.startswith(b"HTTP/1.1 200 OK\r\n")
            got.append(warc.read_record(member))
    assert sorted(got, key=str) == sorted((r[:5] for r in brute(rows)), key=str)


def test_a_payload_that_was_changed_is_refused():
    good = warc.record(1, "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest(), 0, None)
    assert warc.read_record(good)[:2] == (1, 7)
    with pytest.raises(ValueError, match="urn:page:1"):
        warc.read_record(warc.record(1, "http://a/", b"payload", hashlib.sha256(b"other").hexdigest(), 0, None))


@pytest.mark.parametrize("runs, size", [(0, 5), (1, 5), (2, 1), (7, 9), (33, 40), (64, 3)])
def test_merge_of_runs(runs, size):
    rnd = random.Random(runs * 100 + size)
    blocks = []
    for run in range(runs):
        its = sorted(((rnd.choice("abc"), rnd.randint(0, 3), rnd.choice([None, 1, 2]), run, 0, k, 1) for k in range(rnd.randint(1, size))), key=warc.order_of)
        blocks += [(run, its[k : k + 4]) for k in range(0, len(its), 4)]
    blocks.sort(key=lambda b: warc.order_of(b[1][0]))
    assert list(warc.merge(blocks)) == sorted((c for _, b in blocks for c in b), key=warc.order_of)


def test_a_hot_url_is_cut_through(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://hot/").alias("url"), F.concat(F.lit("h" * 200), (F.col("id") % 2).cast("string")).alias("html"))
    archives, index = warc.archive(pages)
    bounds = warc._bounds(archives.where("run is not null").select("run", "captures"), 8)
    assert len(bounds) == 7 and {b[0] for b in bounds} == {"hot)/"}
    assert [r.page_id for r in index.orderBy("position").collect()] == list(range(3000))
    counted = warc.read_back(archives, index).groupBy("record_type", "refers_to").count().collect()
    assert {tuple(r) for r in counted} == {("response", None, 2), ("revisit", 0, 1499), ("revisit", 1, 1499)}


def test_empty(spark):
    assert warc.round_trip(frame(spark, [])).collect() == []
