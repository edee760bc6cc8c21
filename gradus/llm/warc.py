"""Web archives with an index in global order, merged from locally sorted runs.

Each task writes an archive in segments: gzip members of a WARC record each, so that a segment is a run of an ordinary
``.warc.gz`` file. Of pages with one payload the smallest id is written as a response; the others are revisit records that
refer to it and hold no payload. Beside its segments a task leaves sorted runs of captures (url key, timestamp, page, place).
The runs are merged k ways by a loser tree: blocks of runs are dealt by ranges of keys and reach a task in order of their first
capture, so it holds only the blocks that overlap there. More runs than FAN_IN are merged in groups first. What is read back
is found through the merged index.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import as_bytes, let_go, written

MIN_PAYLOAD = 100
SEGMENT, RUN, BLOCK = 4 << 20, 1 << 16, 256
FAN_IN, SALTS, SAMPLED = 256, 16, 16

_PLACE = "archive: bigint, segment: bigint, offset: bigint, length: bigint"
_CAPTURE = f"struct<url_key: string, stamp: bigint, page_id: bigint, {_PLACE}>"
ARCHIVE = f"archive long, segment long, run long, payload binary, captures array<{_CAPTURE}>"
BLOCKS = f"range long, run long, url_key string, stamp long, page_id long, archive long, segment long, offset long, captures array<{_CAPTURE}>"
INDEX = "range long, place long, url_key string, stamp long, page_id long, archive long, segment long, offset long, length long"
RECORDS = "position long, url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FIELDS = ["url_key", "stamp", "page_id", "archive", "segment", "offset", "length"]
_CAPTURE_ARROW = pa.struct([("url_key", pa.string()), *[(c, pa.int64()) for c in _FIELDS[1:]]])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

Capture = tuple  # (url_key, stamp, page_id, archive, segment, offset, length)


def order_of(capture: Capture) -> tuple:
    """Url key, timestamp, page (null first), then the place, which no two captures share."""
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, *capture[3:6]


def url_key(url: str | None) -> str:
    """The host's labels reversed, then ``)``, path and query: captures of a host and of a page stand together. '' for null."""
    found = re.match(r"(?s).*?://([^/?#]*)([^#]*)", url or "")
    if not found:
        return url or ""
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), found[1])
    return ",".join(reversed(host.split("."))) + ")" + found[2]


# ---------------------------------------------------------------- records


def _line(url: str) -> str:
    """A url on one line: control characters and blanks as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page: int | None, url: str | None, payload: bytes, digest: str, stamp: int, refers_to: int | None) -> bytes:
    """A gzip member with a response record, or a revisit record where ``refers_to`` names another page."""
    name = lambda n: f"<urn:page:{'' if n is None else n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    kind = [("WARC-Type", "response")] if refers_to is None else [("WARC-Type", "revisit"), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers_to))]
    date = (_EPOCH + timedelta(seconds=stamp)).strftime("%Y-%m-%dT%H:%M:%SZ")
    fields = [*kind, ("WARC-Record-ID", name(page)), ("WARC-Date", date), ("WARC-Target-URI", _line(url or name(page)[1:-1])), ("WARC-Payload-Digest", f"sha256:{digest}")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head.encode()) + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(WARC fields in lower case, HTTP block) of a gzip member."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    size = int(fields["content-length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive or of a segment, one after another."""
    while data:
        one = zlib.decompressobj(31)
        one.decompress(data)
        yield data[: len(data) - len(one.unused_data)]
        data = one.unused_data


def _page(urn: str | None) -> int | None:
    number = (urn or "<urn:page:>")[len("<urn:page:") : -1]
    return int(number) if number else None


def read_record(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, type, refers_to) of a record; a response's payload must have the digest that is written."""
    fields, block = parse(member)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload is not the one that was written")
    return _page(fields["warc-record-id"]), size, digest, kind, _page(fields.get("warc-refers-to"))


# ---------------------------------------------------------------- writing


def decided(pages: DataFrame, captured: Column, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, payload, digest, stamp, refers_to): ``refers_to`` is the first page with the same payload, null for responses.

    First pages are found over digests alone. Rows are joined to them over SALTS keys a payload, for a payload may be that of
    a third of all pages.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    stamp = F.coalesce(F.unix_seconds(captured), F.lit(0).cast("long"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), stamp.alias("stamp"))
    shared = rows.where(F.octet_length("payload") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    salted = shared.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return rows.withColumn("salt", salt).join(salted, ["digest", "salt"], "left").select(
        "page_id", "url", "payload", "digest", "stamp", F.when(later, F.col("first")).alias("refers_to")
    )


def write_archives(rows: DataFrame, segment_bytes: int = SEGMENT, run_captures: int = RUN, block: int = BLOCK) -> DataFrame:
    """Archives of ``decided`` rows: segments (archive, segment, payload) and sorted runs of their captures in blocks (run, captures)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        archive, segment, runs, data, captures = TaskContext.get().partitionId(), 0, 0, bytearray(), []

        def segment_row():
            return _row(archive, segment, None, bytes(data), None)

        def run_rows():
            captures.sort(key=order_of)
            for k in range(0, len(captures), block):
                yield _row(archive, None, archive << 24 | runs, None, captures[k : k + block])
            captures.clear()

        for batch in batches:
            columns = [as_bytes(batch.column(c)) if c == "payload" else batch.column(c).to_pylist() for c in _WRITTEN]
            for page, url, payload, digest, stamp, refers_to in zip(*columns, strict=True):
                member = record(page, url, payload, digest, stamp, refers_to)
                if data and len(data) + len(member) > segment_bytes:
                    yield segment_row()
                    data.clear()
                    segment += 1
                captures.append((url_key(url), stamp, page, archive, segment, len(data), len(member)))
                data += member
                if len(captures) >= run_captures:
                    yield from run_rows()
                    runs += 1
        if data:
            yield segment_row()
        yield from run_rows()

    return rows.select(*_WRITTEN).mapInArrow(write, ARCHIVE)


_WRITTEN = ["page_id", "url", "payload", "digest", "stamp", "refers_to"]


def _row(archive: int, segment: int | None, run: int | None, payload: bytes | None, captures: list[Capture] | None) -> pa.RecordBatch:
    listed = pa.array([None if captures is None else [dict(zip(_FIELDS, c, strict=True)) for c in captures]], pa.list_(_CAPTURE_ARROW))
    numbers = [pa.array([x], pa.int64()) for x in (archive, segment, run)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array([payload], pa.binary()), listed], names=["archive", "segment", "run", "payload", "captures"])


def export_archives(archives: DataFrame, uri: str) -> DataFrame:
    """(path, bytes): each archive of ``archives`` as a file ``<archive>.warc.gz`` in a folder that all executors reach.

    A file is written under a name of the task's own and then renamed, so a repeated task leaves a whole file too. An
    archive is what one task of the writer had.
    """

    def export(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(uri)
        store.create_dir(folder)
        out, path, size, attempt = None, None, 0, TaskContext.get().taskAttemptId()

        def close():
            out.close()
            store.move(f"{path}.{attempt}", path)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "bytes"])

        for batch in batches:
            for archive, payload in zip(batch.column("archive").to_pylist(), as_bytes(batch.column("payload")), strict=True):
                name = f"{folder}/{archive:06d}.warc.gz"
                if name != path:
                    if out:
                        yield close()
                    path, size = name, 0
                    out = store.open_output_stream(f"{path}.{attempt}")
                size += out.write(payload)
        if out:
            yield close()

    segments = archives.where("payload is not null").select("archive", "segment", "payload")
    return segments.repartition("archive").sortWithinPartitions("archive", "segment").mapInArrow(export, "path string, bytes long")


# ---------------------------------------------------------------- merging


class LoserTree:
    """Merges sorted lists as they arrive: each leaf is a list's next entry, each inner node the loser of the match below it."""

    def __init__(self) -> None:
        self.leaves: list[deque] = []
        self.of: dict[int, int] = {}
        self.losers: list[int] = []
        self.winner, self.stale = -1, False

    def push(self, run: int, captures: list[Capture]) -> None:
        """Appends a block to its run; the tree is played anew only if the run had nothing left."""
        entries = ((order_of(c), c) for c in captures)
        if run in self.of:
            leaf = self.leaves[self.of[run]]
            self.stale |= not leaf
            leaf.extend(entries)
        else:
            self.of[run] = len(self.leaves)
            self.leaves.append(deque(entries))
            self.stale = True

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.leaves[a], self.leaves[b]
        return bool(x) and (not y or x[0][0] < y[0][0])

    def _play(self) -> None:
        if any(not leaf for leaf in self.leaves):  # runs that are over, or whose next block is yet to come
            live = {run: self.leaves[k] for run, k in self.of.items() if self.leaves[k]}
            self.of, self.leaves = {run: k for k, run in enumerate(live)}, list(live.values())
        k = len(self.leaves)
        won, self.losers = [-1] * k + list(range(k)), [-1] * k
        for node in range(k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = -1 if k == 0 else won[1]
        self.stale = False

    def pop_until(self, limit: tuple | None) -> Iterator[Capture]:
        """The entries before ``limit`` (all, if None) in order."""
        if self.stale:
            self._play()
        while self.winner >= 0:
            leaf = self.leaves[self.winner]
            if not leaf or limit is not None and leaf[0][0] >= limit:
                return
            yield leaf.popleft()[1]
            node, best = (len(self.leaves) + self.winner) // 2, self.winner
            while node:
                if self._beats(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def merge(blocks: Iterable[tuple[int, list[Capture]]]) -> Iterator[Capture]:
    """All captures in order, of (run, captures) blocks that come in order of their first captures."""
    tree = LoserTree()
    for run, captures in blocks:
        yield from tree.pop_until(order_of(captures[0]))
        tree.push(run, captures)
    yield from tree.pop_until(None)


def _captures(batch: pa.RecordBatch) -> Iterator[list[Capture]]:
    for listed in batch.column("captures").to_pylist():
        yield [tuple(c[f] for f in _FIELDS) for c in listed]


def _block_batch(rows: list[tuple[int, int, list[Capture]]]) -> pa.RecordBatch:
    first = [captures[0] for _, _, captures in rows]
    listed = pa.array([[dict(zip(_FIELDS, c, strict=True)) for c in captures] for _, _, captures in rows], pa.list_(_CAPTURE_ARROW))
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)] + [pa.array([c[k] for c in first], pa.string() if k == 0 else pa.int64()) for k in range(6)]
    return pa.RecordBatch.from_arrays([*columns, listed], names=["range", "run", *_FIELDS[:6], "captures"])


def _in_order(blocks: DataFrame, partitions: int) -> DataFrame:
    """Blocks by range, in each in order of their first capture; Spark sorts strings by UTF-8, which is the order of code points, and nulls first."""
    return blocks.repartition(partitions, "range").sortWithinPartitions("range", "url_key", "stamp", "page_id", "archive", "segment", "offset").select("range", "run", "captures")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, list[Capture]]]]]:
    """(range, its blocks) one after another; each range's blocks must be used up before the next."""
    rows = ((r, run, c) for b in batches for r, run, c in zip(b.column("range").to_pylist(), b.column("run").to_pylist(), _captures(b), strict=True))
    ahead = next(rows, None)

    def of(which: int) -> Iterator[tuple[int, list[Capture]]]:
        nonlocal ahead
        while ahead is not None and ahead[0] == which:
            yield ahead[1:]
            ahead = next(rows, None)

    while ahead is not None:
        yield ahead[0], of(ahead[0])


def _dealt(runs: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Blocks of ``runs`` cut at the bounds of the ranges."""
    shared = runs.sparkSession.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run, captures in zip(batch.column("run").to_pylist(), _captures(batch), strict=True):
                a = 0
                while a < len(captures):
                    at = bisect_right(shared.value, order_of(captures[a]))
                    b = len(captures) if at == len(shared.value) else next((k for k in range(a, len(captures)) if order_of(captures[k]) >= shared.value[at]), len(captures))
                    out.append((at, run, captures[a:b]))
                    a = b
            if out:
                yield _block_batch(out)

    return runs.select("run", "captures").mapInArrow(deal, BLOCKS)


def _bounds(runs: DataFrame, ranges: int) -> list[tuple]:
    """Captures that cut all of them into about even ranges, from about SAMPLED * ``ranges`` that a hash draws."""
    total = runs.agg(F.sum(F.size("captures"))).first()[0] or 0
    each = runs.select(F.explode("captures").alias("c")).select("c.*")
    drawn = each.where(F.pmod(F.xxhash64(*_FIELDS), F.lit(1 << 30)) < min(1.0, SAMPLED * ranges / max(total, 1)) * (1 << 30))
    sample = sorted(order_of(tuple(r)) for r in drawn.toLocalIterator())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def _grouped(runs: DataFrame, groups: int, block: int) -> DataFrame:
    """Runs merged in ``groups`` groups, each into one longer run."""
    spark, first = runs.sparkSession, F.get("captures", F.lit(0))
    blocks = runs.select(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("range"), "run", *[first[c].alias(c) for c in _FIELDS[:6]], "captures")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, its in _ranges(batches):
            held: list[Capture] = []
            for capture in merge(its):
                held.append(capture)
                if len(held) == block:
                    yield _block_batch([(group, group, held)])
                    held = []
            if held:
                yield _block_batch([(group, group, held)])

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return written(_in_order(blocks, partitions).mapInArrow(combine, BLOCKS).select("run", "captures"), "runs")


def merged_index(runs: DataFrame, fan_in: int = FAN_IN, block: int = BLOCK) -> DataFrame:
    """(position, url_key, stamp, page_id, archive, segment, offset, length) of all captures, ``position`` from 0 in their global order.

    ``runs`` has blocks (run, captures) of sorted runs. A task merges at most about ``fan_in`` runs at once and holds a block
    or two of each.
    """
    spark = runs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while (n := runs.agg(F.count_distinct("run")).first()[0]) > fan_in:
        runs = _grouped(runs, math.ceil(n / fan_in), block)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for which, its in _ranges(batches):
            rows: list[Capture] = []
            place = 0
            for capture in merge(its):
                rows.append((which, place, *capture))
                place += 1
                if len(rows) == 4096:
                    yield _index_batch(rows)
                    rows = []
            if rows:
                yield _index_batch(rows)

    placed = written(_in_order(_dealt(runs, _bounds(runs, partitions)), partitions).mapInArrow(number, INDEX), "index")
    # A row for each range.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(sizes), "range").select((F.col("before") + F.col("place")).alias("position"), *_FIELDS)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "url_key" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)


# ---------------------------------------------------------------- reading back


def read_back(archives: DataFrame, index: DataFrame) -> DataFrame:
    """A row for each capture of ``index``, read from its place in ``archives``."""
    places = index.groupBy("archive", "segment").agg(F.collect_list(F.struct("offset", "length", "position", "url_key")).alias("places"))  # bounded by a segment
    segments = archives.where("payload is not null").select("archive", "segment", "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        names = [c.split()[0] for c in RECORDS.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in RECORDS.split(", ")]
        for batch in batches:
            for payload, places in zip(as_bytes(batch.column("payload")), batch.column("places").to_pylist(), strict=True):
                out = [(p["position"], p["url_key"], *read_record(payload[p["offset"] : p["offset"] + p["length"]])) for p in sorted(places, key=lambda p: p["offset"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return segments.join(places, ["archive", "segment"]).select("payload", "places").mapInArrow(read, RECORDS)


def by_id() -> Column:
    """A capture time for pages that have none: as many seconds after 1970 as the id says, up to 2106."""
    return F.timestamp_seconds(F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0).cast("long")), F.lit(1 << 32)))


def archive(pages: DataFrame, captured: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes ``pages`` (page_id, url, html) to archives and merges their index: (archives, index).

    ``captured`` is the timestamp of a capture (null: 1970; years to 9999). A null html is an empty payload; a null url has
    the key ''. Payloads of less than MIN_PAYLOAD bytes are all responses. A row without an id refers to the first page with
    its payload, if one has an id, and is referred to by none; rows that repeat the first page's id are responses. Long
    payloads are written whole, in a segment of their own. An empty table has no archives.
    """
    written_out = written(write_archives(decided(pages, by_id() if captured is None else captured)), "archives")
    return written_out, merged_index(written_out.where("run is not null").select("run", "captures"))


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's columns for each page as its record in the archives says, its url key and its place in the global order."""
    archives, index = archive(pages)
    return read_back(archives, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")
