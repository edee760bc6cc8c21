import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradus.llm import jaccard_join as j
from gradus.llm.components import components

DOCS = "doc_id long, text string, n long, node string, row_key string"


def shingles(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    ws = [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, family=60):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    rows = [" ".join(word() for _ in range(rnd.choice([1, 3, 4, 5, 6, 9, 30, 120]))) for _ in range(80)]
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(rnd.choice([10, 100]))) for _ in range(40)]
    for base_words in ([word() for _ in range(110)], [word() for _ in range(700)], [word() for _ in range(9)]):
        for _ in range(family):
            edited = base_words.copy()
            for _ in range(rnd.randrange(max(2, len(edited) // 14))):
                edited[rnd.randrange(len(edited))] = word()
            rows.append(" ".join(edited))
    rows += [rows[5], rows[5].upper(), rows[90], None, "", " \n\t", "one", "ONE", "two three", "Élan vital a b c", "élan vital a b c"]
    rnd.shuffle(rows)
    out = list(enumerate(rows, 10))
    return out + [(None, rows[3]), (None, "lonely words that nobody else has at all"), out[7], (out[8][0], "same id other text here now")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS).repartition(4)


@pytest.mark.parametrize(("small", "frequent_at"), [(32, 24), (2, 3), (4, 8), (3, 10_000)])
def test_components_against_brute_force(spark, small, frequent_at):
    rows = corpus(small)
    got = j.near_duplicates(frame(spark, rows), small=small, frequent_at=frequent_at).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_signatures_lose_no_similar_pair():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 20, 63, 64, 90, 200, 700):
        for _ in range(40):
            base = rng.choice(np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), n, replace=False)
            a, b = base.copy(), base[rng.random(n) > rng.random() * 0.2]
            b = np.unique(np.r_[b, rng.integers(1, 1 << 62, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)])
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            frequent = np.unique(rng.choice(a, int(rng.integers(0, len(a) + 1)), replace=False))
            x, y = j.signatures(a, frequent), j.signatures(b, frequent)
            assert len(np.intersect1d(x[0], y[0])) or len(np.intersect1d(x[1], y[1])), (n, len(frequent))


def test_drop_keeps_one_of_each(spark):
    rows = corpus(1, family=6)
    docs = frame(spark, rows)
    out = j.drop_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted(str(r.doc_id) for r in out.collect() if shingles(r.text))
    comps = brute(rows)
    assert set(got) >= {str(c) for _, n, c in comps if n and c is not None} and len(got) == len({c for _, n, c in comps if n and c is not None}) + 2  # no id; an id of two texts
    assert sum(not shingles(r.text) for r in out.collect()) == sum(not shingles(t) for _, t in rows)


def test_empty(spark):
    assert j.near_duplicates(frame(spark, [])).collect() == []
    assert j.near_duplicates(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()[1].component_id == 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(60, 61), (61, 60), (70, 70)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 150)) and got[61] == got[60] == 60
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_texts(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(60_000)]
    edited = words.copy()
    for _ in range(1500):
        edited[rnd.randrange(len(edited))] = "new"
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:20_000])), (4, "short text of its own here")]
    got = sorted(tuple(r) for r in j.near_duplicates(frame(spark, rows)).collect())
    assert got == brute(rows) and [c for *_, c in got] == [1, 1, 3, 4]
