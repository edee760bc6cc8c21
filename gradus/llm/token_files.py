"""Token ids in files of independent Huffman blocks.

A document's ids and its end id are coded by one canonical code, whose lengths come from counts over the whole corpus and
are at most ``LONGEST`` bits, or more where the vocabulary has more symbols than such codes. A file is the sorted output of one task, one row a block; a block holds whole documents, the
place of its first token in the file, and the bit offset of every ``STEP``-th token. The codebook is a table of code lengths.
Blocks need nothing but the codebook: any block is decoded alone, and its checkpoints side by side with a lookup table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import as_bytes, discard, scratch_path, written
from gradus.llm.tokens import encoder

LONGEST = 18
STEP = 128
#: A block ends with the document that brings it to this many tokens.
BLOCK_TOKENS = 1 << 18

TOKENS = "doc_id long, ids binary"
BLOCKS = "file long, block long, start long, doc_ids array<long>, lengths array<long>, checkpoints binary, payload binary"
READ = "doc_id long, start long, ids array<int>"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def tokenise(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids as little-endian integers of 2 bytes, or 4 for large vocabularies), the end id included."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = [enc.encode(t) + end for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, TOKENS)


def count_ids(tokens: DataFrame, dtype: str) -> DataFrame:
    """(id, n) over the whole table; each task adds up its own ids before the shuffle."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=len(total))
            got[: len(total)] += total
            total = got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code: the best prefix code of at most ``longest`` bits (package-merge). Unused symbols have 0.

    More symbols than codes of ``longest`` bits get as many bits as they need.
    """
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        bits[used] = 1
        return bits
    longest = max(longest, (len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, weights = [], leaves
    is_leaf = np.ones(len(leaves), bool)
    for _ in range(longest - 1):
        levels.append(is_leaf)
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        merged = np.argsort(both, kind="stable")
        weights, is_leaf = both[merged], merged < len(leaves)
    levels.append(is_leaf)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        bits[order[:n]] += 1
        take = 2 * (take - n)
    return bits


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(bits), np.int64)
    code = before = 0
    for s in sorted(np.flatnonzero(bits).tolist(), key=lambda s: (bits[s], s)):
        code <<= int(bits[s]) - before
        codes[s], before = code, int(bits[s])
        code += 1
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, bytes]:
    """The checkpoints (bit offset of every STEP-th id) and the coded ids, padded so that a reader may look ahead."""
    n = bits[ids]
    ends = np.cumsum(n)
    at = ends - n
    word, shift = at >> 5, at & 31
    value = codes[ids] << (64 - shift - n)
    words = np.bincount(word, value >> 32 & 0xFFFFFFFF, minlength=(int(ends[-1]) >> 5) + 2 if len(ids) else 2)
    low = np.bincount(word + 1, value & 0xFFFFFFFF, minlength=len(words))
    return at[::STEP].astype("<u8").tobytes(), (words + low[: len(words)]).astype(">u4").tobytes()


def decoding_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """By the next ``width`` bits: the symbol, the bits of its code."""
    width = max(1, int(bits.max(initial=1)))
    symbols, lengths = np.zeros(1 << width, np.int32), np.ones(1 << width, np.int64)
    codes = canonical_codes(bits)
    for s in np.flatnonzero(bits).tolist():
        first, n = int(codes[s]) << (width - int(bits[s])), 1 << (width - int(bits[s]))
        symbols[first : first + n], lengths[first : first + n] = s, bits[s]
    return symbols, lengths, width


def decode_block(checkpoints: bytes, payload: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The block's ``n`` ids: all checkpoints advance together, one id a step."""
    symbols, lengths, width = table
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)]).astype(np.int64)
    ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    out = np.empty((len(at), STEP), np.int32)
    last, mask = len(ahead) - 1, (1 << width) - 1
    for k in range(STEP):
        seen = ahead[np.minimum(at >> 3, last)] >> (32 - width - (at & 7)) & mask
        out[:, k] = symbols[seen]
        at += lengths[seen]
    return out.reshape(-1)[:n]


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes ``docs`` (doc_id, text) to ``path``/codebook and ``path``/blocks in ascending doc_id order, nulls first.

    A null or empty text is the end id alone. Rows with the same doc_id follow each other in order of their ids. An empty
    table gives an empty codebook and no blocks.
    """
    spark = docs.sparkSession
    dtype = encoder(vocabulary).dtype.str
    tokens = written(tokenise(docs, vocabulary, end_id), "tokens")
    counted = count_ids(tokens, dtype).collect()  # a row for each id of the vocabulary at most
    counts = np.zeros(1 + max((r.id for r in counted), default=0), np.int64)
    for r in counted:
        counts[r.id] = r.n
    bits = code_lengths(counts)
    book = [(int(s), int(bits[s])) for s in np.flatnonzero(bits)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((canonical_codes(bits), bits))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, start = TaskContext.get().partitionId(), 0, 0
        docs_in, parts, size = [], [], 0

        def block() -> pa.RecordBatch:
            checkpoints, payload = encode_block(np.frombuffer(b"".join(parts), dtype).astype(np.int64), *shared.value)
            lengths = [len(p) // np.dtype(dtype).itemsize for p in parts]
            row = {"file": file, "block": number, "start": start, "doc_ids": docs_in, "lengths": lengths, "checkpoints": checkpoints, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs_in.append(doc)
                parts.append(ids)
                size += len(ids) // np.dtype(dtype).itemsize
                if size >= block_tokens:
                    yield block()
                    number, start, docs_in, parts, size = number + 1, start + size, [], [], 0
        if parts:
            yield block()

    in_order = tokens.repartitionByRange("doc_id", F.crc32("ids")).sortWithinPartitions("doc_id", F.crc32("ids"), "ids")
    in_order.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    discard(tokens)


_BLOCK_ARROW = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])


def _decoded(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """``rows(doc_ids, starts, ids of each document)`` of every block."""
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = stored.select("file", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    before, total = {}, 0
    for r in sizes.orderBy("file").collect():  # a row for each file
        before[r.file], total = total, total + r.n
    book = spark.read.parquet(f"{path}/codebook").collect()  # a row for each id of the vocabulary at most
    bits = np.zeros(1 + max((r.id for r in book), default=0), np.int64)
    for r in book:
        bits[r.id] = r.bits
    shared = spark.sparkContext.broadcast((before, bits))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lengths = shared.value
        table = decoding_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                ends = np.cumsum(b["lengths"], dtype=np.int64)
                ids = decode_block(b["checkpoints"], b["payload"], int(ends[-1]), table)
                first = starts[b["file"]] + b["start"] + ends - np.array(b["lengths"])
                yield rows(b["doc_ids"], first, np.split(ids, ends[:-1]))

    return stored.mapInArrow(decode, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) as written."""

    def rows(docs, starts, ids):
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return _decoded(spark, path, READ, rows)


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, without handing the ids on."""

    def rows(docs, starts, ids):
        crcs = [zlib.crc32(x.astype("<u4")) for x in ids]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array([len(x) for x in ids], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _decoded(spark, path, DIGEST, rows)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-files")
    write_files(docs, path, vocabulary, end_id)
    return file_digest(docs.sparkSession, path)
