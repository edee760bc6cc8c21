"""Token counts of documents from flat token files that have no index, by a scan for the end-of-document id.

A flat file is a stream of ids in blocks of a fixed number of tokens, wherever documents end. Each block is searched for the
separator as one array; the documents that blocks cut are then stitched by a prefix scan over the blocks' summaries
(tokens, separators, last separator), so no block waits for the one before it and no ids move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import as_bytes, written
from gradus.llm.tokens import encoder

BLOCK_TOKENS = 1 << 16
#: Blocks that one prefix scan takes; their totals are scanned above them.
RUN = 1024


def write_flat(docs: DataFrame, vocabulary: str, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of ``docs`` (text): rows (file, block, payload) of 4-byte ids, a separator after each document.

    Special tokens' strings in a text are ordinary text, so only ends of documents have the separator's id.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, number, held = encoder(vocabulary, literal=True), TaskContext.get().partitionId(), 0, bytearray()
        end, size = np.array([separator], enc.dtype).tobytes(), block_tokens * enc.dtype.itemsize
        wide = lambda b: np.frombuffer(b, enc.dtype).astype("<u4").tobytes()
        row = lambda b: pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number]), pa.array([wide(b)])], names=["file", "block", "payload"])
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                held += enc.encode(text) + end
                while len(held) >= size:
                    yield row(bytes(held[:size]))
                    del held[:size]
                    number += 1
        if held:
            yield row(bytes(held))

    return docs.select("text").mapInArrow(blocks, "file long, block long, payload binary")


def scan_blocks(flat: DataFrame, separator: int) -> DataFrame:
    """(file, block, n, found): each block's tokens, and the places in it where documents end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, "<u4") for b in as_bytes(batch.column("payload"))]
            found = [np.flatnonzero(x == separator) for x in ids]
            columns = [batch.column("file"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "n", "found"])

    return flat.mapInArrow(scan, "file long, block long, n long, found array<long>")


def stitch(scanned: DataFrame, run: int = RUN) -> DataFrame:
    """(file, doc_no, start, n_tokens): documents in order in each file; n_tokens without the separator.

    Tokens after a file's last separator are a document that was never ended; it comes last, with ``ended`` false.
    """
    # The windows carry a block's summary; the places found in it are joined to it again.
    runs = scanned.select("file", "block", "n", F.size("found").alias("k"), F.array_max("found").alias("furthest"), F.floor(F.col("block") / run).alias("run"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = runs.select(
        "file", "run", "block", "n", "k", "furthest",
        F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("start"), F.coalesce(F.sum("k").over(inside), F.lit(0)).alias("docs"),
    ).withColumn("last", F.col("start") + F.col("furthest"))
    local = local.withColumn("prior", F.max("last").over(inside))
    totals = local.groupBy("file", "run").agg(F.sum("n").alias("run_n"), F.sum("k").alias("run_docs"), F.max("last").alias("run_last"))
    above = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("run_start", F.coalesce(F.sum("run_n").over(above), F.lit(0)))
    totals = totals.select(
        "file", "run", "run_start", F.coalesce(F.sum("run_docs").over(above), F.lit(0)).alias("docs_before"),
        F.max(F.col("run_start") + F.col("run_last")).over(above).alias("last_before"),
        (F.row_number().over(Window.partitionBy("file").orderBy(F.desc("run"))) == 1).alias("last_run"),
    )
    placed = local.join(totals, ["file", "run"]).select(
        "file", "block", (F.col("docs_before") + F.col("docs")).alias("docs"), "k", "furthest", (F.col("run_start") + F.col("start")).alias("start"), "n",
        (F.coalesce(F.col("run_start") + F.col("prior"), F.col("last_before"), F.lit(-1)) + 1).alias("open"), "last_run",
    )
    ends = scanned.select("file", "block", "found").join(placed, ["file", "block"]).select(
        "file", F.posexplode(F.transform("found", lambda x, i: F.struct(
            F.when(i == 0, F.col("open")).otherwise(F.col("start") + F.element_at("found", F.greatest(i, F.lit(1))) + 1).alias("start"),
            (F.col("start") + x).alias("end")))).alias("i", "d"), "docs",
    ).select("file", (F.col("docs") + F.col("i")).alias("doc_no"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = placed.where("last_run").groupBy("file").agg(
        F.max(F.col("start") + F.col("n")).alias("stop"), F.max(F.col("docs") + F.col("k")).alias("doc_no"),
        F.max(F.when(F.col("k") > 0, F.col("start") + F.col("furthest") + 1).otherwise(F.col("open"))).alias("start"),
    ).where("stop > start").select("file", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ends.unionByName(tail)


def token_counts(docs: DataFrame, vocabulary: str, separator: int) -> DataFrame:
    """Writes the flat files of ``docs`` and counts each document's tokens from them.

    Null and empty texts have 0 tokens; a repeated row is a document of its own; a long text goes on over many blocks. An
    empty table has no documents.
    """
    return stitch(written(scan_blocks(written(write_flat(docs, vocabulary, separator), "flat"), separator), "scanned"))
