import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from gradus.llm import packing, separator_scan, token_files
from gradus.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, length string, part int"
PARTS = ["a", "b", "Zé", "  ", " ", "\n", "\t", "'s", "'LL", "1", "23", "!", "...", " ", "ß", "É", "İ", "e\u0301", "中文", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "_", "😀", "\r\n", "Σ", "\x00", "×", "ª"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("literal", [False, True])
def test_encoder_equals_the_library(path, literal):
    e = Encoder(path, literal)
    for t in [*texts(3000), "the " * 500 + "end"]:
        assert np.frombuffer(e.encode(t.encode()), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert e.encode(None) == b""


ROWS = [(i * 3 % 40, t) for i, t in enumerate(texts(40, 2))] + [(None, "null id"), (100, None), (101, ""), (7, "again"), (7, "again"), (200, "long text " * 4000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS).repartition(3)


def ids_of(path, text, end):
    e = Encoder(path)
    return np.array([*np.frombuffer(e.encode(text.encode() if text is not None else None), e.dtype), end], "<u4")


def test_token_files_round_trip(spark, tmp_path):
    token_files.write_files(frame(spark, ROWS), str(tmp_path / "f"), WORD, 1, block_tokens=300)
    got = token_files.read_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist()
    want = sorted((str(i), ids_of(WORD, t, 1).tolist()) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    digest = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_files.file_digest(spark, str(tmp_path / "f")).collect()}
    assert all(digest[r.doc_id, r.start] == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4"))) for r in got)


def test_token_files_empty(spark):
    assert token_files.round_trip(frame(spark, []), WORD).collect() == []


def test_huffman_lengths():
    rng = np.random.default_rng(0)
    for counts, longest in ((rng.integers(0, 9, 40), 6), (2 ** np.arange(20), 8), (np.array([5]), 18), (np.array([0, 3, 0, 4]), 18)):
        bits = token_files.code_lengths(np.array(counts), longest)
        used = bits[bits > 0]
        assert bits.max() <= longest and ((bits > 0) == (np.array(counts) > 0)).all() and (2.0**-used).sum() <= 1
        ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 50))
        rng.shuffle(ids)
        points, payload = token_files.encode_block(ids, token_files.canonical_codes(bits), bits)
        assert (token_files.decode_block(points, payload, len(ids), token_files.decoding_table(bits)) == ids).all()
    free = token_files.code_lengths(2 ** np.arange(10), 18)
    assert sorted(free.tolist()) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9]


def test_separator_scan(spark):
    docs = frame(spark, ROWS)
    flat = separator_scan.write_flat(docs, BYTE, 50256, block_tokens=37).persist()
    got = separator_scan.stitch(separator_scan.scan_blocks(flat, 50256), run=3).orderBy("file", "doc_no").collect()
    streams = {}
    for r in flat.orderBy("file", "block").collect():
        streams.setdefault(r.file, []).extend(np.frombuffer(r.payload, "<u4").tolist())
    want = []
    for file, ids in sorted(streams.items()):
        at = 0
        for k, end in enumerate(np.flatnonzero(np.array(ids) == 50256).tolist()):
            want.append((file, k, at, end - at, True))
            at = end + 1
    assert [tuple(r) for r in got] == want and len(want) == len(ROWS)
    e = Encoder(BYTE, literal=True)
    lengths = sorted(len(e.encode(t.encode() if t is not None else None)) // 2 for _, t in ROWS)
    assert sorted(r.n_tokens for r in got) == lengths


def test_separator_scan_keeps_an_open_end_and_empty_tables(spark):
    rows = [(0, 0, np.array([5, 0, 7], "<u4").tobytes()), (0, 1, np.array([8, 9], "<u4").tobytes()), (0, 2, np.array([4], "<u4").tobytes())]
    flat = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "file long, block long, payload binary")
    got = separator_scan.stitch(separator_scan.scan_blocks(flat, 0), run=1).orderBy("doc_no").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 1, True), (0, 1, 2, 4, False)]
    assert separator_scan.token_counts(frame(spark, []), BYTE, 50256).collect() == []


def test_packing(spark):
    got = packing.pack(frame(spark, ROWS), BYTE, 0).collect()
    per = {}
    for r in got:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in per.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist() and sum(n for _, n in places) <= 2048
    want = []
    for i, t in ROWS:
        ids = ids_of(BYTE, t, 0)
        k = -(-len(ids) // 2048)
        cuts = [0, *[len(ids) - 2048 * j for j in range(k - 1, -1, -1)]]
        want += [(i, j, a, b - a, zlib.crc32(ids[a:b])) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert packing.pack(frame(spark, []), BYTE).collect() == []


def test_best_two_fit_is_tight():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 2049, 3000), rng.integers(600, 800, 500), np.array([2048, 1]), np.full(7, 1000), rng.integers(1, 6, 5000)):
        counts = np.bincount(lengths, minlength=2049)
        patterns = packing.best_two_fit(counts)
        back = np.zeros(2049, int)
        for times, p in patterns:
            assert sum(n * k for n, k in p) <= 2048
            for n, k in p:
                back[n] += times * k
        assert (back == counts).all()
        bins, gaps = 0, []
        for n in sorted(lengths.tolist(), reverse=True):  # first fit, longest first
            for i, g in enumerate(gaps):
                if g >= n:
                    gaps[i] -= n
                    break
            else:
                gaps.append(2048 - n)
        assert sum(t for t, _ in patterns) <= len(gaps) * 1.01 + 1


def test_codes_for_large_vocabularies():
    assert token_files.code_lengths(np.ones(70, np.int64), 4).max() == 7
    ids = np.array([0, 3_000_000, 7, 3_000_000])
    bits = token_files.code_lengths(np.bincount(ids))
    points, payload = token_files.encode_block(ids, token_files.canonical_codes(bits), bits)
    assert (token_files.decode_block(points, payload, 4, token_files.decoding_table(bits)) == ids).all()


def test_full_caches_keep_ids_right(monkeypatch):
    from gradus.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 20)
    monkeypatch.setattr(tokens, "PARTS", 5)
    for path in (WORD, BYTE):
        e = Encoder(path)
        for t in texts(400, 5) + [f"1{c} {c}1 {c}, ({c}) x{c}'s" for c in ("word", "Word", "é", "WORD")]:
            assert np.frombuffer(e.encode(t.encode()), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert max(len(e.pieces), len(e.spaced), len(e.parts)) <= 21


def test_stitching_of_many_short_documents(spark):
    """Mostly empty texts: a block's separators are joined to its summary, not carried through the windows."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "if(id % 50 = 0, 'some text', '') AS text")
    got = separator_scan.token_counts(docs, BYTE, 50256).groupBy("n_tokens").count().collect()
    assert {r.n_tokens: r["count"] for r in got} == {0: 4900, len(ids_of(BYTE, "some text", 0)) - 1: 100}
