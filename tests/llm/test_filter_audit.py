import random
import re
from itertools import permutations

from gradus.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, good string, mask string, row_key string, n long"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    said = {}
    for i, quality, toxic in labels:
        if i is not None:
            was = said.get(i, (False, False))
            said[i] = (was[0] or quality == 1, was[1] or toxic == 1)
    out = {}
    fails = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
        fails.append((lang or "", {k for k in f if f[k]}, *said.get(i, (False, False))))
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left, gone = mine, []
            for k, c in enumerate(order):
                removed, left = [m for m in left if c in m[0]], [m for m in left if c not in m[0]]
                shapley[c] += len(removed)
                out[part, order, k + 1] = [
                    len(left), len(removed), sum(c in m[0] for m in gone), sum(m[0] == {c} for m in mine), sum(m[1] for m in removed), sum(m[2] for m in removed)
                ]
                gone += removed
        for order in orders:
            for k, c in enumerate(order):
                out[part, order, k + 1].append(shapley[c])
    return {k: tuple(v) for k, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 7) for r in rows], DOCS)


def found(spark, rows, labels):
    got = fa.interactions(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def sample():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(4))
    rows = []
    for i in range(120):
        text = rnd.choice([" ", "\n", "\t "]).join(word() for _ in range(rnd.choice([20, 99, 100, 101, 200])))
        text = text.upper() if rnd.random() < 0.2 else text
        text += rnd.choice(["", "", " 5% & *", "|"])
        rows.append((i, rows[-1][1] if rows and rnd.random() < 0.3 else text, rnd.choice(["xx", "yy", None, ""])))
    rows += [(200, None, "xx"), (201, "", "xx"), (202, " \t\n\x0b\x0c\r ", None), (None, rows[3][1], "yy"), (None, rows[3][1], "yy"), (7, rows[7][1], rows[7][2])]
    rows += [(8, rows[8][1], "xx"), (203, "w " * 50_000, "zz"), (204, " ".join(f"v{k}" for k in range(60_000)), "zz"), (205, "ABCDEFGHIJ", "zz"), (206, "A" + "é" * 9, "zz")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 130, 2)] + [(3, None, 1), (3, 1, None), (3, 0, 0), (None, 1, 1), (200, 1, 1)]
    return rows, labels


def test_against_brute_force(spark):
    rows, labels = sample()
    assert found(spark, rows, labels) == brute(rows, labels)


def test_totals_of_repeated_rows(spark):
    rows = [(1, "a b a", "x")] * 3 + [(1, "a b c", "x"), (2, "", "x"), (3, None, "x")]
    got = {(r.n_words, r.n_distinct) for r in fa.word_totals(frame(spark, rows)).collect()}
    assert got == {(3, 2), (3, 3), (0, 0)}


def test_a_hot_group_of_copies(spark):
    rows = [(i, "the same text", "x") for i in range(3000)] + [(5000 + i, f"own {i}", "x") for i in range(50)]
    got = found(spark, rows, [])
    assert got["x", "EABCD", 1] == (51, 2999, 0, 0, 0, 0, 2999 * 60) and got["x", "ABCDE", 5][:2] == (0, 0)


def test_empty(spark):
    assert found(spark, [], [(1, 1, 1)]) == {}
