"""How far the sources of a language diverge in their terms: a sort-based streaming count.

Each task tokenises its documents in chunks as arrays, sorts the chunk's terms by (lang, term, source, document) and scans the
run lengths: a run of a document's term gives its count, the runs of a source's term its document frequency. Only these
partial counts are shuffled: repartitioned by (lang, term), sorted within a partition by (lang, term, source) and scanned
again, so that a term's run holds a row for each source and ends in its document frequency. Kept terms are then streamed a
second time behind a head row for each source of the language, and each run adds to the partial pairs of its sources and
offers its terms. A common term has a row for each chunk and source, never one for each document.

Shares are exact: a term's count, smoothed, in parts of BASE, rounded down in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import let_go, written

BASE, PRIOR, MIN_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Bytes of text that are sorted at once; a longer document is counted in slices of as many.
CHUNK = 10 << 20
#: Numbers in a block of shares (terms by sources), sources up to which sums of pairs are held, and offers before they are cut.
BLOCK, HELD, OFFERS = 1 << 21, 2048, 1 << 17

RUNS = "lang string, term string, source string, docs long, n long"
FOUND = "lang string, source string, part string, item string, value long"
_RUN_NAMES = [c.split()[0] for c in RUNS.split(", ")]
_FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]
_GAP = 32


def _fold() -> np.ndarray:
    """What each byte of a text becomes: letters and parts of other characters stay, A-Z in lower case; the rest separates."""
    table = np.full(256, _GAP, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of folded bytes, and where each begins; ``starts`` are the places at which a document begins."""
    inside = data != _GAP
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = starts[starts < len(data)]
    first[cuts] |= inside[cuts]
    at = np.flatnonzero(first)
    lengths = np.add.reduceat(inside.view(np.uint8), at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]), at


def changes(*columns) -> np.ndarray:
    """The places at which a run of equal values begins."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        same = c[1:] != c[:-1] if isinstance(c, np.ndarray) else pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[1:] |= same
    return np.flatnonzero(new)


def _text(values: pa.Array) -> pa.Array:
    return values.cast(pa.binary()).cast(pa.string())


def _chunk_runs(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, documents, count) of documents that begin at ``starts`` of ``data`` and are of the given groups."""
    found, at = tokens(data, starts)
    coded = found.dictionary_encode()
    order = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)
    place[order] = np.arange(len(group))
    doc = place[np.searchsorted(starts, at, "right") - 1]
    key = coded.indices.to_numpy().astype(np.int64) * len(group) + doc
    terms = coded.dictionary
    del found, at, doc, coded
    key.sort()
    of_doc = changes(key)
    count = np.diff(np.append(of_doc, len(key)))
    term, groups = key[of_doc] // len(group), group[order][key[of_doc] % len(group)]
    of_group = changes(term, groups)
    docs = np.diff(np.append(of_group, len(of_doc)))
    n = np.add.reduceat(count, of_group) if len(of_group) else count
    return terms.take(pa.array(term[of_group])), groups[of_group], docs, n


def _long_runs(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(term, count) of one document, in slices that end between terms."""
    whole, at = None, 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and data[end] != _GAP:
            gap = np.flatnonzero(data[end : end + CHUNK] == _GAP)
            end = end + int(gap[0]) if len(gap) else min(end + CHUNK, len(data))
        term, _, _, n = _chunk_runs(data[at:end], np.zeros(1, np.int64), np.zeros(1, np.int64))
        part = pa.table({"term": term, "n": n})
        whole = part if whole is None else pa.concat_tables([whole, part]).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
        at = end
    return whole.column("term").combine_chunks(), whole.column("n").to_numpy()


def partial_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, docs, n) for each chunk of ``docs`` (lang, source, text; none null)."""
    fold = _fold()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            lang, source, text = (batch.column(c) for c in ("lang", "source", "text"))
            pairs = pa.table({"lang": lang, "source": source})
            groups = pairs.group_by(["lang", "source"], use_threads=False).aggregate([]).sort_by([("lang", "ascending"), ("source", "ascending")])
            number = {pair: k for k, pair in enumerate(zip(*(groups.column(c).to_pylist() for c in ("lang", "source")), strict=True))}
            group = np.array([number[pair] for pair in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64)
            text = text.cast(pa.large_binary()) if not pa.types.is_large_string(text.type) else text.view(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            a = 0
            while a < len(text):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
                folded, starts = fold[data[offsets[a] : offsets[b]]], offsets[a:b] - offsets[a]
                if b == a + 1 and len(folded) > CHUNK:
                    term, n = _long_runs(folded)
                    of, in_docs = np.full(len(n), group[a]), np.ones(len(n), np.int64)
                else:
                    term, of, in_docs, n = _chunk_runs(folded, starts, group[a:b])
                if len(term):
                    named = [groups.column(c).combine_chunks().take(pa.array(of)) for c in ("lang", "source")]
                    yield pa.RecordBatch.from_arrays([named[0], _text(term), named[1], pa.array(in_docs), pa.array(n)], names=_RUN_NAMES)
                a = b

    return docs.select("lang", "source", "text").mapInArrow(scan, RUNS)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, head) of the terms in at least ``min_docs`` documents of their lang; ``head`` is 1 in a term's first row."""
    runs = partial_runs(docs).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rest = None
        for batch in _then_none(batches):
            rows = rest if batch is None else pa.table(batch.columns, names=_RUN_NAMES)
            if batch is not None and rest is not None:
                rows = pa.concat_tables([rest, rows]).combine_chunks()
            if rows is None or not len(rows):
                continue
            lang, term, source = (rows.column(c).combine_chunks() for c in ("lang", "term", "source"))
            of_source = changes(lang, term, source)
            docs_, n = (np.add.reduceat(rows.column(c).to_numpy(), of_source) for c in ("docs", "n"))
            rows = pa.table([*(c.take(pa.array(of_source)) for c in (lang, term, source)), docs_, n], names=_RUN_NAMES)
            of_term = changes(rows.column("lang").combine_chunks(), rows.column("term").combine_chunks())
            whole = len(rows) if batch is None else int(of_term[-1])
            rest, starts = rows.slice(whole), of_term[of_term < whole]
            if not len(starts):
                continue
            frequent = np.add.reduceat(docs_[:whole], starts) >= min_docs
            stays = np.repeat(frequent, np.diff(np.append(starts, whole)))
            head = np.zeros(whole, np.int64)
            head[starts] = 1
            out = rows.slice(0, whole).append_column("head", pa.array(head)).filter(pa.array(stays)).drop_columns(["docs"]).combine_chunks()
            yield from out.to_batches()

    return runs.mapInArrow(scan, "lang string, term string, source string, n long, head long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(BASE * (count + PRIOR) / (total + PRIOR * terms)), by long division in steps of 1000; totals up to 9 * 10^15."""
    over, under = count + PRIOR, total + PRIOR * terms
    out, left = np.divmod(over, under)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, under)
        out = out * 1000 + digit
    return out + 1


class _Language:
    """The partial pairs and offered terms of one language in one task."""

    def __init__(self, name: str, sources: pa.Array, totals: np.ndarray, terms: int, whole: bool):
        self.name, self.sources, self.totals, self.terms = name, sources, totals, terms
        self.zero = shares(np.zeros_like(totals), totals, terms) if terms else np.zeros_like(totals)
        self.all, self.used = int(totals.sum()), whole
        self.sums = np.zeros((len(totals),) * 2, np.int64) if len(totals) <= HELD else None
        self.offers: pa.Table | None = None

    def add(self, term: pa.Array, source: pa.Array, n: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
        self.used = True
        at = pc.index_in(source, value_set=self.sources).to_numpy(zero_copy_only=False)
        starts = changes(term)
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
        share, q = shares(n, self.totals[at], self.terms), shares(np.add.reduceat(n, starts), np.int64(self.all), self.terms)
        more = np.flatnonzero(share > q[number])
        offered = pa.table({"source": at[more], "value": share[more] - q[number][more], "item": term.take(pa.array(more))})
        self.offers = offered if self.offers is None else pa.concat_tables([self.offers, offered])
        if len(self.offers) > OFFERS:
            self._cut(top)
        size = max(1, BLOCK // len(self.totals))
        for first in range(0, len(starts), size):
            mine = (number >= first) & (number < first + size)
            block = np.tile(self.zero, (min(size, len(starts) - first), 1))
            block[number[mine] - first, at[mine]] = share[mine]
            yield from self._pairs(block)

    def _pairs(self, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(len(self.totals)):
            apart = np.abs(block - block[:, s : s + 1]).sum(axis=0)
            if self.sums is None:
                yield self._row(s, apart)
            else:
                self.sums[s] += apart

    def _row(self, s: int, apart: np.ndarray) -> pa.RecordBatch:
        others = np.flatnonzero(np.arange(len(apart)) != s)
        return self._found("pair", np.full(len(others), s), self.sources.take(pa.array(others)), apart[others])

    def _found(self, part: str, source: np.ndarray, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        n = len(value)
        columns = [pa.array([self.name] * n, pa.string()), self.sources.take(pa.array(source)), pa.array([part] * n, pa.string()), item, pa.array(value)]
        return pa.RecordBatch.from_arrays(columns, names=_FOUND_NAMES)

    def _cut(self, top: int) -> None:
        """The first ``top`` offers of each source."""
        rows = self.offers.sort_by([("source", "ascending"), ("value", "descending"), ("item", "ascending")]).combine_chunks()
        starts = changes(rows.column("source").to_numpy())
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        self.offers = rows.filter(pa.array(place < top))

    def end(self, top: int) -> Iterator[pa.RecordBatch]:
        if self.used and len(self.totals) > 1:
            zeros = np.zeros(len(self.totals), np.int64)
            for s in range(len(self.totals)):
                yield self._row(s, zeros if self.sums is None else self.sums[s])
        if self.offers is not None and len(self.offers):
            self._cut(top)
            yield self._found("term", self.offers.column("source").to_numpy(), self.offers.column("item").combine_chunks(), self.offers.column("value").to_numpy())


_STREAM = ["part", "lang", "kind", "term", "source", "n", "terms"]


def _stream(top: int):
    """Runs of kept terms behind their language's head rows; every task sums its pairs and keeps its best terms of a language."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rest, current = None, None
        for batch in _then_none(batches):
            rows = rest if batch is None else pa.table(batch.columns, names=_STREAM)
            if batch is not None and rest is not None:
                rows = pa.concat_tables([rest, rows]).combine_chunks()
            if rows is None or not len(rows):
                continue
            kind = rows.column("kind").to_numpy()
            lang, term = (rows.column(c).combine_chunks() for c in ("lang", "term"))
            runs = changes(lang, kind, term)
            whole = len(rows) if batch is None else int(runs[-1])
            rest, ready = rows.slice(whole), rows.slice(0, whole).combine_chunks()
            if not whole:
                continue
            of_kind = changes(ready.column("lang").combine_chunks(), kind[:whole])
            for a, b in zip(of_kind, np.append(of_kind, whole)[1:], strict=True):
                here = ready.slice(a, b - a).combine_chunks()
                source, n = here.column("source").combine_chunks(), here.column("n").to_numpy()
                if kind[a] == 0:
                    if current:
                        yield from current.end(top)
                    once = changes(source)  # a partition may hold the head rows of several parts
                    first = not here.column("part").to_numpy().min()
                    current = _Language(here.column("lang")[0].as_py(), source.take(pa.array(once)), n[once], here.column("terms")[0].as_py(), first)
                else:
                    yield from current.add(here.column("term").combine_chunks(), source, n, top)
        if current:
            yield from current.end(top)

    return scan


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of ``docs`` (text, lang, source) is from the others of its lang.

    Part ``pair`` has a row for each other source: the distance of their shares over all kept terms. Part ``term`` has the
    ``top`` terms that the source has and uses more than its lang does, by the difference. Nulls are ''. A source without
    terms, or of a lang without kept terms, has its pairs; a lang of one source has none. Repeated rows are documents of
    their own; long texts are counted whole, in slices. Ties go by item in order of UTF-8. An empty table has no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = written(kept_terms(rows, min_docs), "kept_terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang").agg(F.sum("head").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long0 = F.lit(0).cast("long")
    heads = groups.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "lang", F.lit(0).alias("kind"), F.lit("").alias("term"), "source",
        F.coalesce("n", long0).alias("n"), F.coalesce("terms", long0).alias("terms"),
    )
    part = F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("part")
    dealt = heads.unionByName(kept.select(part, "lang", F.lit(1).alias("kind"), "term", "source", "n", long0.alias("terms")))
    stream = dealt.repartition(parts, "part").sortWithinPartitions("lang", "kind", "term", "source")
    found = stream.select(*_STREAM).mapInArrow(_stream(top), FOUND)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
