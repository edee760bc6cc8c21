"""Secret scans: three fixed patterns, and tokens that pass a battery of randomness tests.

A candidate is a run of 20 or more characters of the usual encodings, with a letter and a digit. Its encoding is inferred from
its characters. Three tests ask whether it could be uniformly random in that alphabet: chi-squared of the character counts,
runs above and below the middle of the alphabet, correlation of neighbours. A candidate that none of them rejects is claimed
a secret if words, numbers and identifiers would hardly look like it: by the ratio of its likelihoods as text and as random
characters of its encoding. Text reaches a ratio of p or less with a chance of at most p, so the ratio is a p-value, and one
with power at 20 characters. False discoveries among the claims are held to RATE by the step-up procedure of Benjamini and
Hochberg over the candidates that pass the battery, in each class of lengths, over p-values in fixed logarithmic bins, so
that only counts of bins are gathered. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import row_key, written
from gradus.llm.line_quality import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

_CODE = "A-Za-z0-9+/_-"
#: A whole run of code characters with a letter and a digit, 20 or longer.
CANDIDATE = rf"(?<![{_CODE}])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[{_CODE}]{{20,}}+"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CODE = UPPER + LOWER + DIGITS + "+/-_"
#: Pattern and alphabet.
ENCODINGS = (
    (r"^[0-9a-f]+$", "0123456789abcdef"), (r"^[0-9A-F]+$", "0123456789ABCDEF"), (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^[a-z0-9]+$", LOWER + DIGITS), (r"^[A-Z0-9]+$", UPPER + DIGITS), (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"), (r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    (r"^.*$", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Capitals, small letters, digits and marks in text: chance of each (row) to be followed by each; the last row is for the start.
FOLLOWS = ((0.58, 0.35, 0.03, 0.04), (0.04, 0.86, 0.04, 0.06), (0.04, 0.04, 0.84, 0.08), (0.15, 0.6, 0.2, 0.05), (0.25, 0.5, 0.2, 0.05))
#: Words of text and of identifiers in four languages: how letters follow each other in them is how they do in text.
WORDS = (
    "the and that have for not with you this but his from they say her she will one all would there their what out about who get which when make can "
    "like time just know take people into year your good some could them see other than then now look only come over think also back after use two how "
    "work first well way even new want because any these give day most user name file data key value index table order service server config report "
    "image model test train page version update local remote storage system network water house access request response session client account number "
    "string message product customer address document version public private default "
    "der die und den von das mit sich des auf nicht eine auch werden nach wird einer haben durch zeichen strasse wasser schule "
    "les des que est pour dans une par sur pas plus avec sont mais comme tout nous vous leur cette etre faire "
    "los las una por con para como pero sus este entre cuando muy sin sobre tambien hasta desde todo nos durante ciudad"
).split()
#: How far a letter goes by the one before it, by its own frequency, by neither.
SHARES = (0.6, 0.3, 0.1)
#: What a pair of letters or a letter that WORDS don't have counts for.
UNSEEN = 0.05
#: A test rejects randomness below REJECT / 3; claims are made at the false-discovery rate RATE.
REJECT, RATE = 0.001, 0.01
#: Shortest length of each class but the first.
CLASSES = (32, 48, 64, 128)
#: Bins of a p-value per factor e, and the least p-value told apart.
BINS, LEAST = 20, 1e-30


def running(steps: Column, first: Column, combine: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """What ``combine`` makes of ``first`` and all elements before each one, as sums or maxima do.

    Appending to an array copies it. So blocks are combined on their own first, and their elements then start from their block's value.
    """
    grown = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def whole(blocks: Column) -> Column:
        ends = grown(F.transform(blocks, lambda b: F.aggregate(F.slice(b, 2, block), F.get(b, F.lit(0)), combine)), first)
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.slice(grown(b, F.get(e, i)), 1, F.size(b)))))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: F.slice(xs, i * block + 1, block))
    return let(steps, lambda xs: F.when(F.size(xs) > 0, let(cut(xs), whole)).otherwise(F.slice(xs, 1, 0)))


def _places(text: Column, pattern: str, group: int = 0, keep: bool = False) -> Column:
    """(start, end) of all matches in code points, by what the text between them takes; with the size of ``group`` and, to ``keep``, the match as value."""
    more = {"size": "int"} if group else {"value": "string"} if keep else {}
    none = F.array().cast(f"array<struct<{', '.join(f'{k}: {v}' for k, v in {'start': 'int', 'end': 'int', **more}.items())}>>")

    def placed(found: Column) -> Column:
        parts = {"gap": F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), "value": found}
        if group:
            parts["size"] = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m))
        # The text after the last match has a gap and no value.
        return let(F.filter(F.arrays_zip(*[c.alias(name) for name, c in parts.items()]), lambda m: m["value"].isNotNull()), hits)

    def hits(ms: Column) -> Column:
        start = lambda m, at: at + m["gap"]
        hit = lambda m, at: F.struct(start(m, at).alias("start"), (start(m, at) + F.length(m["value"])).alias("end"), *[m[k].alias(k) for k in more])
        steps = F.transform(ms, lambda m: m["gap"] + F.length(m["value"]))
        return F.zip_with(ms, running(steps, F.lit(0), lambda x, y: x + y), hit)

    # Most texts have no match, and are not looked at again.
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def find_spans(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, assign, access, hex, candidates): arrays of (start, end) in each text; candidates have a value too. A null text is empty."""
    rows = docs.select(row_key("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    # Runs of hex digits and of capitals and digits match from their start or not at all, so the least length can stand in the pattern.
    return rows.select(
        "row_key", "doc_id", F.filter(_places(text, ASSIGN, 1), lambda m: m["size"] >= MIN_ASSIGN).alias("assign"),
        _places(text, ACCESS[:-1] + f"{{{MIN_ACCESS - 4},}}").alias("access"), _places(text, HEX[:-1] + f"{{{MIN_HEX},}}").alias("hex"),
        _places(text, CANDIDATE, keep=True).alias("candidates"),
    )


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _text_costs() -> tuple[list[float], list[float]]:
    """-ln of the chances of text, each within its encoding's alphabet: of kinds of characters by encoding, kind before and kind, then
    of letters, of all and of hex digits, by letter before (26: none) and letter, from their counts in WORDS."""
    kinds, letters = [], []
    for _, alphabet in ENCODINGS:
        there = [any(c in alphabet for c in of) for of in (UPPER, LOWER, DIGITS, "+/-_")]
        sizes = [1, 1, sum(c in alphabet for c in DIGITS), sum(c in alphabet for c in "+/-_")]
        for row in FOLLOWS:
            whole = sum(p for p, ok in zip(row, there, strict=True) if ok)
            kinds += [math.log(whole * n / p) if ok else 0.0 for p, n, ok in zip(row, sizes, there, strict=True)]
    chances = [[UNSEEN] * 26 for _ in range(27)]
    for word in dict.fromkeys(WORDS):
        places = [LOWER.index(c) for c in word]
        for before, place in zip([None, *places], places, strict=False):
            chances[26][place] += 1
            if before is not None:
                chances[before][place] += 1
    for used in (26, 6):
        parts = [[p / sum(row[:used]) for p in row[:used]] for row in chances]
        for row in parts:
            letters += [-math.log(SHARES[0] * p + SHARES[1] * q + SHARES[2] / used) for p, q in zip(row, parts[26], strict=True)] + [0.0] * (26 - used)
    return kinds, letters


def _table(values: list[float]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(f"{v:.5f}" for v in values)), ",").cast("array<double>")


def text_p(codes: Column, encoding: Column, n: Column, k: Column) -> Column:
    """The likelihood ratio of text to random characters, 1 at most. Text has a ratio of p or less with a chance of p at most (Markov)."""
    kinds, letters = (_table(x) for x in _text_costs())
    kind = lambda x: F.when(x.isNull(), 4).when(x < 26, 0).when(x < 52, 1).when(x < 62, 2).otherwise(3)
    before = lambda x: F.when(x < 52, x % 26).otherwise(26)
    hex_from = F.when(encoding < 2, 27 * 26).otherwise(0)

    def cost(x: Column, last: Column) -> Column:
        letter = F.when(x < 52, F.get(letters, hex_from + before(last) * 26 + x % 26)).otherwise(0.0)
        return F.get(kinds, encoding * 20 + kind(last) * 4 + kind(x)) + letter

    costs = F.zip_with(codes, F.slice(F.concat(F.array(F.lit(None).cast("int")), codes), 1, F.size(codes)), cost)
    return F.least(F.exp(n * F.log(k) - F.aggregate(costs, F.lit(0.0), lambda a, c: a + c)), F.lit(1.0))


def coded(candidates: DataFrame) -> DataFrame:
    """``candidates`` (with value) with columns n, encoding, k, codes and places: each character's index in all code characters and in its encoding's."""
    encoding = F.coalesce(*[F.when(F.col("value").rlike(pattern), F.lit(i)) for i, (pattern, _) in enumerate(ENCODINGS)])
    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    rows = candidates.withColumns({"encoding": encoding, "n": F.length("value").cast("double")}).withColumn("_alphabet", F.get(alphabets, F.col("encoding")))
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    at = lambda c, of: (F.call_function("locate", c, of) - 1).cast("int")
    indices = {"codes": F.transform(chars, lambda c: at(c, F.lit(CODE))), "places": F.transform(chars, lambda c: at(c, F.col("_alphabet")))}
    return rows.withColumns({"k": F.length("_alphabet").cast("double"), **indices}).drop("_alphabet")


def square_counts(places: Column, n: Column) -> Column:
    """The sum of the squared counts of the values: equal ones stand side by side once sorted."""
    firsts = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when(F.coalesce(F.get(xs, i - 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
    times = lambda at: F.transform(at, lambda i, j: F.coalesce(F.get(at, j + 1), n) - i)
    return F.aggregate(let(let(F.sort_array(places), firsts), times), F.lit(0.0), lambda a, c: a + c * c)


def battery(candidates: DataFrame) -> DataFrame:
    """``candidates`` (with value, not empty) with columns encoding, n, k, p_chi, p_runs, p_serial, p_text, random."""
    # Written step by step: a plan that holds all steps names every column's formula at each of its uses.
    return _tests(written(coded(candidates), "coded"))


def _tests(coded: DataFrame) -> DataFrame:
    n, k, df, x = F.col("n"), F.col("k"), F.col("k") - 1, F.col("places")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    high = lambda v: F.when(v * 2 >= k, 1).otherwise(0)
    changes = F.zip_with(F.slice(x, 2, F.size(x)), F.slice(x, 1, F.size(x) - 1), lambda a, b: F.when(high(a) != high(b), 1).otherwise(0))
    rows = coded.withColumns({"_squares": square_counts(x, n), "_mean": total(x) / n, "_high": total(F.transform(x, high)), "_runs": 1 + total(changes)})
    rows = rows.withColumn("_off", F.transform("places", lambda v: v - F.col("_mean")))
    off = F.col("_off")
    rows = rows.withColumns({
        "_spread": total(F.transform(off, lambda v: v * v)),
        "_near": total(F.zip_with(F.slice(off, 2, F.size(off)), F.slice(off, 1, F.size(off) - 1), lambda a, b: a * b)),
    })
    a, b = F.col("_high"), n - F.col("_high")
    rows = rows.withColumn("_expected", 2 * a * b / n + 1)
    expected = F.col("_expected")
    rows = rows.withColumns({"_variance": (expected - 1) * (expected - 2) / (n - 1), "_chi": F.greatest(k / n * F.col("_squares") - n, F.lit(0.0))})
    z = {
        "_z_chi": (F.cbrt(F.col("_chi") / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)), "_z_runs": F.abs(F.col("_runs") - expected) / F.sqrt("_variance"),
        "_z_serial": F.abs(F.col("_near") / F.col("_spread")) * F.sqrt(n),
    }
    rows = rows.withColumns({name: F.when(ok, v) for (name, v), ok in zip(z.items(), (df > 0, F.col("_variance") > 0, F.col("_spread") > 0), strict=True)})
    rows = rows.withColumns({
        "p_chi": F.coalesce(upper_tail(F.col("_z_chi")), F.lit(0.0)), "p_runs": F.coalesce(2 * upper_tail(F.col("_z_runs")), F.lit(0.0)),
        "p_serial": F.coalesce(2 * upper_tail(F.col("_z_serial")), F.lit(0.0)), "p_text": text_p(F.col("codes"), F.col("encoding"), n, k),
    })
    rows = rows.withColumn("random", F.least("p_chi", "p_runs", "p_serial") * 3 >= REJECT)
    return rows.drop("codes", "places", *[c for c in rows.columns if c.startswith("_")])


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """The claims of ``tested``: random ones whose p_text is under the step-up threshold of the random ones of their length class."""
    length_class = sum((F.col("n") >= c).cast("int") for c in CLASSES)
    binned = tested.withColumns({"class": length_class, "bin": F.floor(-F.log(F.greatest("p_text", F.lit(LEAST))) * BINS).cast("int")})
    counts = binned.groupBy("class", "bin").agg(F.count_if("random").alias("m")).where("m > 0")  # at most a row for each class and bin
    smaller = Window.partitionBy("class").orderBy(F.desc("bin"))
    whole = Window.partitionBy("class")
    passing = counts.withColumns({"rank": F.sum("m").over(smaller), "all": F.sum("m").over(whole)}).where(F.exp(-F.col("bin") / BINS) <= rate * F.col("rank") / F.col("all"))
    thresholds = passing.groupBy("class").agg(F.min("bin").alias("least_bin"))
    # One row for each length class.
    return binned.join(F.broadcast(thresholds), "class").where(F.col("random") & (F.col("bin") >= F.col("least_bin")))


def _clear(base: Column, candidates: Column) -> Column:
    """The ``candidates`` that overlap none of ``base``, by the furthest end before each and the nearest start after it."""
    event = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    events = F.sort_array(F.concat(F.transform(base, event(0)), F.transform(candidates, event(1))))

    def apart(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)), F.lit(0), lambda p, q: F.greatest(p, q))
        after = F.transform(F.reverse(xs), lambda x: F.when(x["kind"] == 0, x["start"]).otherwise(_FAR))
        starts = F.reverse(running(after, F.lit(_FAR), lambda p, q: F.least(p, q)))
        placed = F.arrays_zip(xs.alias("x"), ends.alias("before"), starts.alias("after"))
        return F.transform(F.filter(placed, lambda m: (m["x"]["kind"] == 1) & (m["before"] <= m["x"]["start"]) & (m["after"] >= m["x"]["end"])), lambda m: m["x"]["start"])

    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), let(events, apart)).otherwise(F.transform(candidates, lambda c: c["start"]))


_FAR = (1 << 31) - 1


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the fixed patterns and all spans (kind, start, end) in order.

    A random span that overlaps one of a fixed pattern is left out. A null or empty text has no spans; an empty table has no
    rows. Long texts take time in proportion to their length. Repeated rows give repeated rows; each counts in the
    false-discovery control. Spans go by start, then by kind as in KINDS.
    """
    kinded = lambda name, order: F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end")))
    found = written(find_spans(docs), "spans")
    base = found.withColumn("base", F.sort_array(F.concat(*[kinded(name, i) for i, name in enumerate(KINDS[:3])])))
    several = base.where(F.size("candidates") > 0).withColumn("clear", _clear(F.col("base"), F.col("candidates")))
    each = several.select("row_key", "clear", F.explode("candidates").alias("c"))
    each = each.select("row_key", "c.start", "c.end", "c.value", F.array_contains("clear", F.col("c.start")).alias("clear"))
    each = each.repartition("row_key", "start")  # one long text may hold most of them
    tested = written(battery(each), "candidates")
    claims = discoveries(tested).where("clear").groupBy("row_key").agg(F.collect_set(F.struct("start", F.lit(3).alias("kind"), "end")).alias("claims"))
    claims = written(claims, "claims")  # a small table, whose size the planner then knows
    rows = base.select("row_key", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base").join(claims, "row_key", "left")
    return rows.withColumn("spans", F.when(F.col("claims").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "claims")))).drop("claims")


def listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _merged(spans: Column) -> Column:
    """(start, end) of each group of overlapping or touching ``spans``, which are sorted by start."""

    def groups(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda x: x["end"]), F.lit(-1), lambda p, q: F.greatest(p, q))
        first = F.filter(F.arrays_zip(xs["start"].alias("start"), reach.alias("before")), lambda m: m["start"] > m["before"])
        return let(first, lambda f: F.transform(f, lambda m, i: F.struct(m["start"].alias("start"), F.coalesce(F.get(f, i + 1)["before"], F.array_max(xs["end"])).alias("end"))))

    return let(spans, groups)


def _masked(text: Column, groups: Column, mask: str, block: int = 256) -> Column:
    """``text`` with ``mask`` for each of ``groups``. A place is found from the text's start, so blocks of groups are cut out first."""
    ends = F.concat(F.array(F.lit(0)), groups["end"])
    kept = F.arrays_zip(ends.alias("from"), F.concat(groups["start"], F.array(F.length(text))).alias("to"))  # the text between groups

    def blocks(ks: Column) -> Column:
        number = F.floor((F.size(ks) - 1) / block).cast("int")
        part = lambda i: F.slice(ks, i * block + 1, block)

        def cut(of: Column) -> Column:
            at = F.get(of, F.lit(0))["from"]
            inside = lambda whole: F.array_join(F.transform(of, lambda k: F.substr(whole, k["from"] - at + 1, k["to"] - k["from"])), mask)
            return let(F.substr(text, at + 1, F.element_at(of, -1)["to"] - at), inside)

        return F.array_join(F.transform(F.sequence(F.lit(0), number), lambda i: let(part(i), cut)), mask)

    return let(kept, blocks)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span, or group of overlapping or touching spans, replaced by ``mask``; all rows and columns stay, n_chars follows.

    Null texts stay null; texts without spans and an empty table stay as they are; repeated rows stay repeated.
    """
    key, doc, spans = "_gradus_key", "_gradus_doc", "_gradus_spans"
    found = scan(docs).where(F.size("spans") > 0).select(F.col("row_key").alias(key), F.col("doc_id").alias(doc), _merged(F.col("spans")).alias(spans))
    found = written(found.dropDuplicates([key, doc]), "masks")
    mine = docs.withColumn(key, row_key("doc_id", "text"))
    joined = mine.join(found, (mine[key] == found[key]) & F.col("doc_id").cast("long").eqNullSafe(found[doc]), "left").drop(found[key])
    changed = F.col(spans).isNotNull()
    new = {"text": F.when(changed, _masked(F.col("text"), F.col(spans), mask)).otherwise(F.col("text"))}
    out = joined.withColumns(new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
