import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import Row

import corpus_pipeline
from gradus.llm import language_id, queries
from gradus.llm.tokens import Encoder

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
no_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@no_tables
def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs.count(), docs
    from gradus.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, seen, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= seen.count()
        seen = after
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == seen.count() < before
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


WORDS = {"xx": "tok lim pra vun ost ekka minu sorv halt brin", "yy": "amo reli casta donue vira solem pinto grado luce neva"}
SECRET = "password=hunter2hunter2hunter2"


def planted():
    """(doc_id, text, lang): clean rows of two languages, copies, near copies, a benchmark passage, secrets, nulls and repeated rows."""
    rnd = random.Random(21)
    say = lambda k, n: " ".join(rnd.choice(WORDS[k].split()) + str(rnd.randrange(9)) for _ in range(n))
    rows = [(i, say("xy"[i % 2] * 2, 60), "xy"[i % 2] * 2) for i in range(80)]
    leak = say("xx", 14)
    rows += [(100, rows[0][1], "xx"), (101, rows[1][1] + " end", "yy"), (102, say("xx", 20) + " " + leak + " " + say("xx", 20), "xx")]
    rows += [(103, f"{say('xx', 30)} {SECRET} {say('xx', 30)}", "xx"), (104, None, "xx"), (105, "12 34 !?", "yy"), (106, "", None), (None, say("yy", 50), None)]
    return rows + [rows[5], rows[83]], [("item", leak), ("other", "never seen in any of the texts at all my dear friends")]


def brute_pipeline(rows, benchmark, dictionaries):
    """The first four stages with loops: what stays of ``rows``, as (doc_id, text)."""
    compressors = {k: zstandard.ZstdCompressor(level=language_id.LEVEL, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, d in dictionaries.items()}

    def rejected(text):
        if not text or not any(c.isalpha() for c in text):
            return True
        raw = text.encode().lower()
        a, b = sorted(sum(len(c.compress(raw[k : k + 512])) for k in range(0, len(raw), 512)) for c in compressors.values())
        return 1 - a / b < language_id.NARROW

    rows = [r for r in rows if not rejected(r[1])]
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if 100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k]):
                group = [group[k] if g == group[i] else g for g in group]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first = {}
    for i in order:
        first.setdefault(group[i], i)
    rows = [rows[i] for i in sorted(first.values())]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[i : i + 10]) for _, t in benchmark for w in [words(t)] for i in range(max(1, len(w) - 9))}
    rows = [r for r in rows if not any(tuple(words(r[1])[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words(r[1]))))]
    return [(r[0], r[1].replace(SECRET, "[SECRET]")) for r in rows]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, benchmark = planted()
    columns = "doc_id long, text string, lang string, source string, n_chars long, row_key string, n long, spans string, label string"
    docs = spark.createDataFrame([(*r, "s", len(r[1]) if r[1] is not None else None, "clash", 1, "x", "y") for r in rows], columns)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute_pipeline(rows, benchmark, language_id.sample_dictionaries(language_id.training_rows(docs)))
    assert 70 < len(want) < len(rows) and any("[SECRET]" in t for _, t in want)
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = lambda t: np.array([*np.frombuffer(encoder.encode(t.encode()), encoder.dtype), 0], "<u4")
    assert sorted((str(r.doc_id), r.length, r.ids_crc32) for r in pieces) == sorted((str(d), len(ids), zlib.crc32(ids)) for d, t in want for ids in [tokens(t)])
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns
    assert sorted(map(str, seen.select("doc_id", "text", "n_chars").collect())) == sorted(str(Row(doc_id=d, text=t, n_chars=len(t))) for d, t in want)


def test_pipeline_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@no_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, oracle = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(oracle.columns)
    got = sorted((tuple(r) for r in df.select(*oracle.columns).collect()), key=str)
    assert got == sorted(oracle.fetchall(), key=str)
