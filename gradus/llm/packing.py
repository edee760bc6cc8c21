"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Only lengths decide a packing, and there are at most ``capacity`` of them. So the driver packs the histogram of lengths, as
patterns (the lengths of one sequence) with the number of sequences that repeat each, and the tasks look up the place of
each piece from its rank among the pieces of its length. The driver's work does not grow with the corpus.

A sequence is filled greedily with the longest pieces that fit. If a gap stays, its shortest piece is taken out again where
two unpacked pieces fill the gap that this leaves more tightly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import as_bytes, written
from gradus.llm.tokens import encoder

CAPACITY = 2048
PIECES = "part long, doc_id long, piece int, start long, length long, ids_crc32 long, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; the first takes what full pieces leave."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document, ranked within its task among those of the same length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                ids = np.frombuffer(enc.encode(text) + end, enc.dtype).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((part, doc, k, start, length, zlib.crc32(ids[start : start + length]), int(seen[length])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], names=_PIECE_NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


_PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_PIECE_TYPES = [pa.int32() if c.endswith(" int") else pa.int64() for c in PIECES.split(", ")]


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns for ``counts[length]`` pieces: (sequences, [(length, pieces of it in each sequence)])."""
    left = counts.astype(np.int64).copy()
    lengths = np.arange(capacity + 1)
    longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest unpacked length up to each
    patterns = []
    while longest[capacity]:
        took: dict[int, int] = {}
        gap = capacity
        while gap and (length := _longest(left, took, longest, gap)):
            k = min(int(left[length]) - took.get(length, 0), gap // length)
            took[length] = took.get(length, 0) + k
            gap -= k * length
        if gap and len(took) + sum(took.values()) > 2:
            _swap(left, took, gap, lengths)
        times = min(int(left[length]) // k for length, k in took.items())
        for length, k in took.items():
            left[length] -= times * k
        if not all(left[length] for length in took):
            longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        patterns.append((times, sorted(took.items(), reverse=True)))
    return patterns


def _longest(left: np.ndarray, took: dict[int, int], longest: np.ndarray, most: int) -> int:
    length = int(longest[most])
    while length and left[length] <= took.get(length, 0):
        length = int(longest[length - 1])
    return length


def _swap(left: np.ndarray, took: dict[int, int], gap: int, lengths: np.ndarray) -> None:
    """Replaces the shortest piece by two unpacked ones if together they are longer and fit."""
    shortest = min(took)
    room = gap + shortest
    free = left[: room + 1].copy()
    for length, k in took.items():
        if length <= room:
            free[length] -= k
    below = np.maximum.accumulate(np.where(free > 0, lengths[: room + 1], 0))
    a = np.flatnonzero(free > 0)
    if not len(a):
        return
    b = below[np.minimum(a, room - a)]
    single = (b == a) & (free[a] < 2)
    b[single] = below[a[single] - 1]
    total = np.where(b > 0, a + b, 0)
    best = int(np.argmax(total))
    if total[best] > shortest:
        took[shortest] -= 1
        if not took[shortest]:
            del took[shortest]
        for length in (int(a[best]), int(b[best])):
            took[length] = took.get(length, 0) + 1


def _slots(patterns: list) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces in each sequence, first sequence, offset of the first piece)."""
    slots: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for length, k in pattern:
            slots.setdefault(length, []).append((used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + times * k
            offset += k * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequence and offset of each of ``pieces`` (a written table)."""
    spark = pieces.sparkSession
    each = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = each.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in each.groupBy("length").agg(F.sum("n")).collect():  # a row for each length: capacity at most
        counts[length] = n
    slots = spark.sparkContext.broadcast(_slots(best_two_fit(counts, capacity)))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                of = np.flatnonzero(length == size)
                rows = slots.value[size]
                slot = rows[np.searchsorted(rows[:, 0], rank[of], "right") - 1]
                after = rank[of] - slot[:, 0]
                sequence[of] = slot[:, 2] + after // slot[:, 1]
                offset[of] = slot[:, 3] + after % slot[:, 1] * size
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[c.split()[0] for c in PLACED.split(", ")])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, PLACED)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): its place in a sequence of ``capacity`` tokens.

    A document is its ids and ``end_id``; a null or empty text is the end id alone. Only documents longer than ``capacity``
    are cut. Repeated rows and null ids are packed like any other row. An empty table has no pieces.
    """
    return place(written(tokenised_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
