"""Benchmark decontamination over a distributed positional inverted index.

Training documents are cut into segments of a few MB. A segment is one row of the stored index: its documents, and for
each term the positions at which it stands. Positions run on through the segment with a gap between documents, so no
phrase and no proximity window crosses a document. Because an index is sharded by document, a frequent term's postings
are spread over all segments, and each document's matches are found inside its own segment: nothing is shuffled.

A phrase is looked up from its rarest terms: the shortest postings list gives candidate starts, each further term's list,
less the term's offset in the phrase, is intersected with them.

A proximity match is made for each window of an item: of the window's rarest terms that the corpus has, NEAR_TERMS stand
close together, in any order. SPARE more terms than that are tried, so altered and unseen words leave a window's match whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import as_bytes, discard, let_go, row_key, without, written

WINDOW = 10
#: A proximity match has this many of the rarest terms of an item's window, each at most SLOP words from one of them.
NEAR_TERMS, SLOP = 4, 30
#: Terms of a window that may be missing, and words that may be put in. Windows are so long that they still are within SLOP.
SPARE = 2
NEAR_SPAN = SLOP - SPARE
#: Text bytes of a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: Benchmark text that is matched in one pass over the corpus, and so held by each task.
BLOCK_BYTES = 8 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_WORD_BYTES = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

INDEX_SCHEMA = (
    "row_keys array<long>, doc_ids array<long>, n_words array<long>, terms array<binary>, counts array<long>, postings binary"
)
MATCH_SCHEMA = (
    "row_key long, doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>, near_items array<string>"
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters. Null has none."""
    return text.translate(_WORD_BYTES).split() if text else []


def build_index(docs: DataFrame, vocabulary: Iterable[bytes] | None = None) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), one row per segment, not yet stored.

    With a ``vocabulary`` only its terms get postings, which is all that queries made of these terms can look up.
    """
    shared = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else {w: i for i, w in enumerate(vocabulary)})

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            keys, ids = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            texts = as_bytes(batch.column("text"))
            first = size = 0
            for i, text in enumerate(texts):
                size += len(text or b"")
                if size >= SEGMENT_BYTES or i + 1 == len(texts):
                    yield _segment(keys[first : i + 1], ids[first : i + 1], texts[first : i + 1], shared.value)
                    first, size = i + 1, 0

    rows = docs.select(row_key("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(segments, INDEX_SCHEMA)


def _segment(keys: list[int], ids: list[int | None], texts: list[bytes | None], vocabulary: dict[bytes, int] | None) -> pa.RecordBatch:
    found, known = [words(t) for t in texts], {} if vocabulary is None else vocabulary
    if vocabulary is None:
        for ws in found:
            for w in ws:
                known.setdefault(w, len(known))
    lengths = np.array([len(ws) for ws in found], np.int64)
    total = int(lengths.sum())
    terms = np.empty(total, np.int64)
    at = 0
    for ws in found:
        terms[at : at + len(ws)] = np.fromiter(map(known.get, ws, repeat(-1)), np.int64, len(ws))
        at += len(ws)
    positions = np.arange(total) + np.repeat(np.arange(len(found)) * (SLOP + WINDOW), lengths)
    positions, terms = positions[terms >= 0], terms[terms >= 0]
    order = np.argsort(terms, kind="stable")
    present, counts = np.unique(terms, return_counts=True)
    names = list(known)
    row = {
        "row_keys": keys, "doc_ids": ids, "n_words": lengths.tolist(), "terms": [names[t] for t in present.tolist()],
        "counts": counts.tolist(), "postings": positions[order].astype("<u4").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], schema=_INDEX_ARROW)


_INDEX_ARROW = pa.schema(
    [("row_keys", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("postings", pa.binary())]
)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_MATCH_ARROW = pa.schema(
    [("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(_SPAN)), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))]
)


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): occurrences over all segments; reads no postings."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("t.terms", "t.counts")
    return pairs.groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("n"))


def near_queries(ws: list[bytes], counts: dict[bytes, int]) -> set[tuple[tuple[bytes, ...], int]]:
    """(terms, need) of each window of an item: its rarest terms that the corpus has, rarest first, and how many must stand together.

    A window of fewer than NEAR_TERMS different words needs all of them.
    """
    last = max(0, len(ws) - NEAR_SPAN)
    out = set()
    for i in {*range(0, last, NEAR_SPAN // 2), last}:
        window = set(ws[i : i + NEAR_SPAN])
        need = min(NEAR_TERMS, len(window))
        present = sorted((w for w in window if w in counts), key=lambda w: (counts[w], w))[: need + SPARE]
        if len(present) >= need > 0:
            out.add((tuple(present), need))
    return out


def search(index: DataFrame, items: list[tuple[str | None, list[bytes]]], counts: dict[bytes, int]) -> DataFrame:
    """Exact phrase and proximity matches of ``items`` (id, words) in each document of the index."""
    phrases: dict[tuple[bytes, ...], set[str]] = {}
    near: dict[tuple[tuple[bytes, ...], int], set[str]] = {}
    for item, ws in items:
        named = set() if item is None else {item}
        for i in range(max(1, len(ws) - WINDOW + 1)):
            phrase = tuple(ws[i : i + WINDOW])
            if phrase and all(w in counts for w in phrase):
                phrases.setdefault(phrase, set()).update(named)
        for query in near_queries(ws, counts) if named else ():
            near.setdefault(query, set()).update(named)
    # By the term from which each is looked up: a segment then meets only the queries of terms that it has.
    by_rarest: dict[bytes, list] = {}
    for p, of in phrases.items():
        order = sorted(range(len(p)), key=lambda j, p=p: (counts[p[j]], p[j], j))
        by_rarest.setdefault(p[order[0]], []).append((order, p, sorted(of)))
    by_anchor: dict[bytes, list] = {}
    for (rare, need), of in near.items():
        query = (rare, need, sorted(of))
        for r in rare[: len(rare) - need + 1]:
            by_anchor.setdefault(r, []).append(query)
    shared = index.sparkSession.sparkContext.broadcast((by_rarest, by_anchor))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _match(batch.slice(i, 1).to_pylist()[0], *shared.value)

    return index.mapInArrow(match, MATCH_SCHEMA)


def _standing(postings: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each position of ``at`` is in the sorted ``postings``."""
    i = np.searchsorted(postings, at)
    return postings[np.minimum(i, len(postings) - 1)] == at


def _match(segment: dict, by_rarest: dict[bytes, list], by_anchor: dict[bytes, list]) -> pa.RecordBatch:
    flat = np.frombuffer(segment["postings"], "<u4").astype(np.int64)
    ends = np.cumsum(segment["counts"], dtype=np.int64)
    postings = {t: flat[e - n : e] for t, n, e in zip(segment["terms"], segment["counts"], ends.tolist(), strict=True)}
    lengths = np.array(segment["n_words"], np.int64)
    bases = np.cumsum(lengths) - lengths + np.arange(len(lengths)) * (SLOP + WINDOW)
    spans: list[set] = [set() for _ in lengths]
    items: list[set] = [set() for _ in lengths]
    close: list[set] = [set() for _ in lengths]
    for order, phrase, of in (query for term in postings for query in by_rarest.get(term, ())):
        starts = postings[phrase[order[0]]] - order[0]
        for j in order[1:]:
            if not len(starts) or (there := postings.get(phrase[j])) is None:
                starts = starts[:0]
                break
            starts = starts[_standing(there, starts + j)]
        for s, d in zip(starts.tolist(), (np.searchsorted(bases, starts, "right") - 1).tolist(), strict=True):
            spans[d].add((s - int(bases[d]), s - int(bases[d]) + len(phrase)))
            items[d].update(of)
    # Of any ``need`` of a query's terms at least one is among its anchors.
    for r, at in postings.items():
        for rare, need, of in by_anchor.get(r, ()):
            standing = [postings[x] for x in rare if x in postings]
            if len(standing) < need:
                continue
            beside = np.zeros(len(at), np.int64)
            for there in standing:
                beside += np.searchsorted(there, at + SLOP, "right") > np.searchsorted(there, at - SLOP)
            for d in set((np.searchsorted(bases, at[beside >= need], "right") - 1).tolist()):
                close[d].update(of)
    rows = [
        {"row_key": k, "doc_id": i, "n_words": n, "hits": [{"start": a, "end": b} for a, b in _merged(s)], "items": sorted(t), "near_items": sorted(c)}
        for k, i, n, s, t, c in zip(segment["row_keys"], segment["doc_ids"], segment["n_words"], spans, items, close, strict=True)
    ]
    return pa.RecordBatch.from_pylist(rows, schema=_MATCH_ARROW)


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The query set in blocks of bounded size. Items without words match nothing; those without an id hit, but are not listed."""
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null")
    for item, text in items.toLocalIterator():
        if ws := words(text.encode()):
            block.append((item, ws))
            size += len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: its words, merged spans of hit words, items that occur, items that are near.

    ``docs`` has doc_id, text; ``benchmark`` has item_id, text. A null or wordless text has no words and no hits. Repeated
    rows give repeated rows. A document longer than a segment is a segment of its own. An empty benchmark hits nothing, an
    empty table of documents has no rows. A benchmark beyond ``block_bytes`` is matched in several
    passes, whose matches are merged.
    """
    parts, tables = [], []
    for block in item_blocks(benchmark, block_bytes):
        index = written(build_index(docs, sorted({w for _, ws in block for w in ws})), "postings")
        counts = {bytes(r.term): r.n for r in term_counts(index).toLocalIterator()}
        parts.append(search(index, block, counts))
        tables.append(index)
    if not parts:
        parts.append(search(build_index(docs, []), [], {}))
    if len(parts) == 1:
        return parts[0]
    merged = None
    for part in parts:
        numbered = part.withColumn("copies", F.lit(1))
        merged = numbered if merged is None else merged.unionByName(numbered)
    passes = len(parts)
    union = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    grouped = merged.groupBy("row_key", "doc_id", "n_words").agg(union("hits"), union("items"), union("near_items"), F.sum("copies").alias("copies"))
    out = written(grouped.select("row_key", "doc_id", "n_words", *[n for n in ("hits", "items", "near_items")], F.expr(f"explode(sequence(1, int(copies / {passes})))").alias("copy")).drop("copy"), "matches")
    discard(*tables)
    return out.withColumn("hits", _merge_spans(F.col("hits")))


def _merge_spans(hits):
    """Overlapping spans of a sorted array joined to one."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(hits, F.slice(hits, 1, 0), step)


def hit_words() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; other rows and all columns unchanged. Repeated rows stay or go alike."""
    return without(docs, find_contamination(docs, benchmark).where(F.size("hits") > 0))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, with the number of items that are near."""
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )
