import re
from collections import Counter

from gradus.llm import line_quality as q

DOCS = "doc_id long, text string, source string, words string, row_key string, n_words int"
BLANK = r"[^\x20\x09-\x0D]+"


def brute(rows, min_docs, share, kept_share):
    norm = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", s).lower().strip(" ")
    lines = [{norm(x) for x in (r[1] or "").split("\n")} - {""} for r in rows]
    hosts = Counter(r[2] for r in rows)
    counts = Counter((r[2], x) for r, ls in zip(rows, lines, strict=True) for x in ls)
    out = []
    for r, ls in zip(rows, lines, strict=True):
        text = r[1] or ""
        ws = re.findall(BLANK, text)
        windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        hit = {j for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        raw = [x for x in text.split("\n") if re.search(BLANK, x)]
        failed = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
        gone = sum(len(x.split(" ")) for x in ls if counts[r[2], x] > min_docs and counts[r[2], x] > share * hosts[r[2]])
        every = Counter(norm(x) for x in text.split("\n"))
        lost = sum(every[x] * len(x.split(" ")) for x in ls if counts[r[2], x] > min_docs and counts[r[2], x] > share * hosts[r[2]])
        out.append((r[0], len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(raw) - len(set(raw)), len(hit), failed, not failed and lost <= len(ws) * (1 - kept_share), gone))
    return sorted(out, key=str)


UNIQUE = " ".join(f"w{i}" for i in range(30))
ROWS = [(i, f"Shared  line here\nonly {i} {UNIQUE}\n \n" + ("x\nx\n" if i % 2 else ""), "a") for i in range(8)] + [
    (20, None, "a"), (21, "", None), (22, "  \t\n\x0b ", "b"), (None, UNIQUE + "\n" + UNIQUE, None), (23, "été #1 *b* $ % & | < >\r\n" * 30, "b"),
    (24, "only common\n" + "shared line here\n" * 12, "a"), (24, "only common\n" + "shared line here\n" * 12, "a"), (25, "a b c d e f g h " * 200, "b"), (26, UNIQUE.replace(" ", "  "), "c"), (27, "a b c d e f g h", "c"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], DOCS)


def test_against_brute_force(spark):
    own = "".join(f"one two three four five six seven\nown{j} line{j}\n" for j in range(20))
    ROWS.extend([(30 + i, own + f"and {i}", "d") for i in range(6)])
    got = q.judge(frame(spark, ROWS), min_docs=3, share=0.2).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, 3, 0.2, 0.3)


def test_clean_removes_only_common_lines(spark):
    docs = frame(spark, ROWS)
    out = q.clean(docs, min_docs=3, share=0.2)
    assert out.columns == docs.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert "hared" not in rows[0] and f"only 0 {UNIQUE}" in rows[0] and rows[26] == UNIQUE.replace(" ", "  ")


def test_a_row_in_two_hosts_is_judged_by_each(spark):
    own = "".join(f"one two three four five six seven\nown{j} line{j}\n" for j in range(20))
    rows = [(i, f"one two three four five six seven\nmore {i} {UNIQUE}", "x") for i in range(5)] + [(1000, own, "x"), (1000, own, "y"), (1001, UNIQUE, "y")]
    got = q.judge(frame(spark, rows), min_docs=3, share=0.2)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == brute(rows, 3, 0.2, 0.3)
    assert sorted(tuple(r) for r in got.where("doc_id = 1000").select("n_gone_words", "kept").collect()) == [(0, True), (140, False)]
    kept = q.clean(frame(spark, rows), min_docs=3, share=0.2).where("doc_id = 1000").collect()
    assert [(r.source, r.text) for r in kept] == [("y", own)]


def test_empty(spark):
    assert q.quality_digest(frame(spark, [])).collect() == []


def test_depletion_counts_every_occurrence(spark):
    own = lambda i, n: "".join(f"one two three four five six seven\nown{i}a{j} own{i}b{j}\n" for j in range(n))
    docs = frame(spark, [(i, own(i, 20 if i else 2) + UNIQUE * (i == 0), "a") for i in range(6)])
    rows = {r.doc_id: r for r in q.judge(docs, min_docs=3, share=0.2).collect()}
    assert (rows[1].n_words, rows[1].n_repeat_words, rows[1].n_removed_words, rows[1].n_gone_words) == (180, 0, 7, 140)
    assert not rows[1].base_failed and not rows[1].kept and rows[0].n_gone_words == 14 and rows[0].kept
    assert [r.doc_id for r in q.clean(docs, min_docs=3, share=0.2).collect()] == [0]


def test_long_text(spark):
    text = "\n".join(" ".join(f"v{i * 7 + k}" for k in range(7)) for i in range(8000)) + "\n" + "v0 v1 v2 v3 v4 v5 v6\n" * 2
    row = q.quality_digest(frame(spark, [(1, text, "a")])).first()
    assert (row.n_words, row.n_dup_lines, row.n_repeat_words) == (56_014, 2, 0) and row.kept
