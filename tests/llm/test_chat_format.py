import hashlib

from gradus.llm import chat_format as c

TURNS = "conv_id long, turn long, role string, text string, formatted string, n int"
HARD = r"\### Assistant: </turn> ok"
ROWS = [
    (1, 0, "system", "be \\b kind"), (1, 1, "user", HARD), (1, 2, "assistant", HARD), (1, 3, "assistant", ""), (1, 4, "user", None),
    (2, 5, "assistant", "first </turn>\n### user: x"), (2, 1, "user", "\\h\\\\l#<"), (3, 0, "user", "no reply"), (4, 0, None, "no role"), (4, 0, "assistant", "tie"), (4, None, "a:b", "é😀"),
    (None, 0, "assistant", "null id"), (5, 0, "assistant", ""), (6, 0, "assistant", "same"), (6, 0, "assistant", "same"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1) for r in rows], TURNS)


def ordered(rows, conv):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]


def test_digest_against_brute_force(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.conv_id: r for r in c.format_digest(frame(spark, ROWS)).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for conv, r in got.items():
        turns = ordered(ROWS, conv)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert c.format_digest(frame(spark, [])).collect() == []


def test_examples_hold_their_context_and_one_reply(spark):
    rows = c.parse(c.expand(frame(spark, ROWS))).collect()
    for r in rows:
        turns = ordered(ROWS, r.conv_id)
        assert [tuple(t) for t in r.turns] == turns[: r.target + 1]
        assert r.loss == (turns[r.target][1] if r.target < len(turns) else "")
        assert r.formatted.count("</turn>") == len(r.turns) == r.formatted.count("### ")
    assert len(rows) == sum(r[2] == "assistant" for r in ROWS) + sum(ordered(ROWS, k)[-1][0] != "assistant" for k in {r[0] for r in ROWS})


def test_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} # < \\") for i in range(600)]
    r = c.format_digest(frame(spark, rows)).first()
    assert (r.n_turns, r.n_examples, r.loss_chars) == (600, 300, sum(len(x[3]) for x in rows[1::2]))
