import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradus.llm import source_divergence as sd

DOCS = "doc_id long, text string, lang string, source string, term string, n long, part string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = terms_of(text)
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(count, total):
            return 1 + 1_000_000_000 * (count + 5) // (total + 5 * len(kept))

        n = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        p = {s: {t: share(n[s][t], sum(n[s].values())) for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "pair") for r in rows], DOCS)


def found(spark, rows, least, top):
    return sorted(tuple(r) for r in sd.divergence(frame(spark, rows), least, top).collect())


def sample(n=300, seed=2):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abÉéZz") for _ in range(rnd.randint(1, 4))) for _ in range(80)]
    rows = []
    for i in range(n):
        words = [rnd.choice(vocabulary[: rnd.randint(5, 80)]) for _ in range(rnd.randint(0, 40))]
        rows.append((i, rnd.choice([" ", "1", ",\n", "\x00"]).join(words), rnd.choice(["xx", "xx", "yy", None, ""]), rnd.choice(["s1", "s1", "s2", "s3", None, "é"])))
    rows += [(900, None, "xx", "quiet"), (901, "", "solo", "one"), (902, "12 34", "solo", "two"), (903, "€uro @[`{ x", "xx", "s1"), rows[0], rows[0], (None, "aa zz", "yy", "s2")]
    return rows


@pytest.mark.parametrize("least, top", [(30, 50), (3, 4), (1, 1000)])
def test_against_brute_force(spark, least, top):
    rows = sample()
    assert found(spark, rows, least, top) == brute(rows, least, top)


def test_long_documents_in_slices(monkeypatch):
    fold = sd._fold()
    monkeypatch.setattr(sd, "CHUNK", 16)
    for text in ("a", "Ab1bé zz zz", "x" * 300, " a" * 200, "ab cd1" * 3000):
        term, n = sd._long_runs(fold[np.frombuffer(text.encode(), np.uint8)])
        assert dict(zip((t.decode() for t in term.to_pylist()), n.tolist(), strict=True)) == Counter(terms_of(text))


def test_a_document_longer_than_a_chunk(spark):
    rows = sample(40) + [(950, "ab cd1é " * 2_500_000, "xx", "s1"), (951, "b" * 5000 + " ab", "xx", "s2")]
    assert found(spark, rows, 2, 5) == brute(rows, 2, 5)


def test_pairs_in_blocks_and_without_held_sums(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    sources, n = pa.array([f"s{k}" for k in range(5)]), rnd.integers(1, 50, (7, 5))
    terms = [f"t{k}" for k in range(7)]

    def run():
        one = sd._Language("x", sources, n.sum(axis=0), 7, True)
        got = [r for b in one.add(pa.array(np.repeat(terms, 5)), pa.array([f"s{k}" for k in range(5)] * 7), n.reshape(-1), 2) for r in b.to_pylist()]
        got += [r for b in one.end(2) for r in b.to_pylist()]
        pairs, offers = Counter(), []
        for r in got:
            if r["part"] == "pair":
                pairs[r["source"], r["item"]] += r["value"]
            else:
                offers.append((r["source"], r["item"], r["value"]))
        return pairs, sorted(offers)

    want = run()
    assert len(want[0]) == 20
    for name, value in (("BLOCK", 6), ("HELD", 2), ("OFFERS", 3)):
        monkeypatch.setattr(sd, name, value)
        assert run() == want


def test_shares_are_exact():
    rnd = random.Random(1)
    for _ in range(2000):
        total = rnd.choice([10, 10**6, 10**12, 8 * 10**15])
        count, terms = rnd.randint(0, total), rnd.randint(1, 10**6)
        assert int(sd.shares(np.array([count]), np.array([total]), terms)[0]) == 1 + 10**9 * (count + 5) // (total + 5 * terms)


def test_terms_keep_code_points_and_documents_apart():
    fold = sd._fold()
    texts = ["Ab", "", "cD é", "É1x", ""]
    data = fold[np.frombuffer("".join(texts).encode(), np.uint8)]
    starts = np.cumsum([0, *[len(t.encode()) for t in texts[:-1]]])
    got, at = sd.tokens(data, starts)
    assert [t.decode() for t in got.to_pylist()] == [t for x in texts for t in terms_of(x)] and at.tolist() == [0, 2, 5, 7, 10]


def test_empty(spark):
    assert found(spark, [], 30, 50) == []
