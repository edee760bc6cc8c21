import hashlib
import random
import re

from gradus.llm import decontamination as d

DOCS = "doc_id long, text string, lang string, row_key string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    lower = lambda t: WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, text, *_ in docs:
        ws, hit, ids = lower(text), set(), set()
        for item, t in items:
            b = lower(t)
            if item is None or not b:
                continue
            for p in [b[k : k + 10] for k in range(max(1, len(b) - 9))]:
                for s in range(len(ws) - len(p) + 1):
                    if ws[s : s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        ids.add(str(item))
        out.append((i, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEM = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, f"Aa {ITEM.upper()} zz. {ITEM}", "en", "x"), (2, "one two three four five six seven eight nine", "en", "x"), (3, None, None, None),
    (4, "", "en", "x"), (None, f"{ITEM} x", "en", "x"), (5, "short\nITEM! Élan", "en", "x"), (5, "short\nITEM! Élan", "en", "x"),
    (6, "twelve eleven ten nine eight seven six five four three two one", "en", "x"), (7, "tick " * 3000 + ITEM, "en", "x"),
    (8, "one two three four five six seven eight nine ten", "en", "x"), (9, "eleven twelve", "en", "x"),
]
ITEMS = [(10, ITEM), (11, "short item"), (2, "tick tick"), (12, None), (None, ITEM), (13, "..."), (10, ITEM), (14, "absent words")]


def result(spark, rows, items, **kw):
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, n_words int")
    return docs, bench, d.contamination_digest(docs, bench)


def test_against_brute_force(spark):
    _, _, got = result(spark, ROWS, ITEMS)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute(ROWS, ITEMS)


def test_blocks_give_the_same(spark):
    docs, bench, _ = result(spark, ROWS, ITEMS)
    one = d.find_contamination(docs, bench).orderBy("doc_id", "row_key").collect()
    assert one == d.find_contamination(docs, bench, block_bytes=20).orderBy("doc_id", "row_key").collect()


def test_proximity_takes_any_order(spark):
    docs, bench, got = result(spark, ROWS, [(10, ITEM)])
    near = {r.doc_id: r.n_near for r in got.collect()}
    assert near[6] == 1 and near[9] == 0


def test_empty_tables_and_full_index(spark):
    docs, bench, got = result(spark, [], ITEMS)
    assert got.collect() == []
    docs, bench, got = result(spark, ROWS, [])
    assert not any(r.contaminated for r in got.collect()) and got.count() == len(ROWS)
    index = d.build_index(docs)
    counts = {bytes(r.term): r.n for r in d.term_counts(index).collect()}
    assert counts[b"tick"] == 3000 and counts["Élan".encode().lower()] == 2


def test_drop_keeps_clean_rows_and_columns(spark):
    docs, bench, _ = result(spark, ROWS, [(10, ITEM)])
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "3", "4", "5", "5", "6", "9"])


def test_exact_and_lightly_edited_copies_are_near(spark):
    rnd = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    items = [[rnd.choice(common) if rnd.random() < 0.6 else f"r{rnd.randrange(4000)}" for _ in range(rnd.randrange(15, 60))] for _ in range(120)]
    rows, edits = [], {}
    for i, ws in enumerate(items):
        altered, longer, shorter, unseen = (list(ws) for _ in range(4))
        for k in rnd.sample(range(len(ws)), 2):
            altered[k] = "c0"
            unseen[k] = f"unseen{i}"
        longer[5:5], shorter[4:6] = ["c1", "c2"], []
        # The item that the corpus only has edited: its words at two places are in no document.
        for j, copy in enumerate([ws, altered, longer, shorter] if i % 2 else [unseen, altered]):
            edits[1000 * j + i] = i
            rows.append((1000 * j + i, " ".join(["start", *copy, "end"]), "en", "x"))
    rows += [(90_000 + i, " ".join(rnd.choices(common, k=50)), "en", "x") for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r.near_items for r in d.find_contamination(docs, bench).collect()}
    assert [k for k, i in edits.items() if str(i) not in got[k]] == []


def test_items_without_id_hit_but_are_not_listed(spark):
    _, _, got = result(spark, ROWS, [(None, ITEM)])
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].contaminated and rows[1].n_hit == 24 and rows[1].n_items == 0 and rows[1].n_near == 0 and not rows[9].contaminated
