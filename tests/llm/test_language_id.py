import random
import zlib

import zstandard

from gradus.llm import language_id as lang

DOCS = "doc_id long, text string, lang string, score string, row_key string"
WORDS = {"xx": "tok lim pra vun ost ekka minu sorv halt brin".split(), "yy": "amo reli casta donue vira solem pinto grado luce neva".split()}


def rows(n, seed=0):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[k]) for _ in range(60)), k) for i in range(n) for k in [("xx", "yy")[i % 2]]]


def frame(spark, data):
    return spark.createDataFrame([(*r, "s", "k") for r in data], DOCS)


def test_held_out_accuracy_and_edges(spark):
    extra = [(900, None, "xx"), (901, "", "xx"), (902, "12 34 !!", "yy"), (None, WORDS["xx"][0] * 9, "xx"), (903, "tok lim " * 40, None), (904, "amo reli " * 9000, "xx"), (905, "½①²", "xx"), (906, "½ ª", "xx")]
    data = rows(300) + extra
    got = {r.doc_id: r for r in lang.identify(frame(spark, data)).collect()}
    held = [r for r in rows(300) if got[r[0]].held_out]
    assert {i for i, _, _ in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i].lang_pred == k for i, _, k in held) / len(held) > 0.97
    for i in (900, 901, 902, 905):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[906].lang_pred in WORDS and got[903].lang_pred == "xx" and got[904].lang_pred == "yy" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())


def test_rejection_keeps_clean_rows(spark):
    docs = frame(spark, rows(200) + [(900, None, "xx"), (901, "?!", "yy")])
    kept = lang.drop_rejected(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(195)) and kept.where("doc_id >= 900").count() == 0


def test_nothing_learned(spark):
    got = lang.identify(frame(spark, [(1, "text", None)])).collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [("und", True)] and lang.identify(frame(spark, [])).collect() == []


def test_labels_are_no_input(spark):
    dictionaries = lang.sample_dictionaries(lang.training_rows(frame(spark, rows(100))))
    a = lang.classify(frame(spark, rows(50)), dictionaries).orderBy("doc_id").select("lang_pred", "score").collect()
    assert a == lang.classify(frame(spark, [(i, t, "zz") for i, t, _ in rows(50)]), dictionaries).orderBy("doc_id").select("lang_pred", "score").collect()


def test_copies_of_one_text_leave_the_dictionary_full(spark):
    texts = [(i, f"{t} {i}", k) for i, t, k in rows(6000)]
    copies = spark.range(1_000_000).selectExpr("'xx' AS lang", "'tok lim pra' AS text")
    labelled = frame(spark, texts).select("lang", "text").unionByName(copies)
    dictionaries = lang.sample_dictionaries(labelled)
    assert {k: len(v) for k, v in dictionaries.items()} == {"xx": lang.DICTIONARY, "yy": lang.DICTIONARY}
    short = spark.range(40_000).selectExpr("'xx' AS lang", "concat('a', id) AS text")
    assert len(lang.sample_dictionaries(short)["xx"]) == lang.DICTIONARY


def test_a_language_of_one_repeated_text_is_learned(spark):
    once = "zil vok arrem tadu, sen pirok"
    docs = frame(spark, rows(300)).unionByName(spark.range(1000, 5000).selectExpr("id AS doc_id", f"'{once}' AS text", "'zz' AS lang", "'s' AS score", "'k' AS row_key"))
    dictionaries = lang.sample_dictionaries(lang.training_rows(docs))
    assert dictionaries["zz"] == once.encode() + b"\n" and set(dictionaries) == {"xx", "yy", "zz"}
    assert {r.lang_pred for r in lang.identify(docs).where("doc_id >= 1000").collect()} == {"zz"}


def test_sizes_and_winner_against_plain_compression(spark):
    dictionaries = lang.sample_dictionaries(lang.training_rows(frame(spark, rows(60))))
    texts = [t for _, t, _ in rows(40, 3)] + ["tok amo", "x", "TOK LIM pra " * 2000, "é" * 700, "1", "½①²", "Ⅷ ٣"]
    got = lang.classify(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), dictionaries).orderBy("doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        raw = text.encode().lower()
        sizes = {}
        for name, words in dictionaries.items():
            d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=lang.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(raw[k : k + lang.CHUNK])) for k in range(0, len(raw), lang.CHUNK))
        first, second = sorted(sizes, key=lambda name: (sizes[name], name))
        want = (first, 1 - sizes[first] / sizes[second]) if any(ch.isalpha() for ch in text) else ("und", 0.0)
        assert (r.lang_pred, r.score) == want and r.rejected == (want[0] == "und" or want[1] < lang.NARROW)
