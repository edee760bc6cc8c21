"""Quality rules: base measures of each document, and lines that too many documents of its host repeat.

Lines are normalised (A-Z and other capitals lower-cased, blanks joined, ends trimmed) and hashed. A line is boilerplate on a
host if more documents of the host hold it than MIN_DOCS and than SHARE of the host's documents. Boilerplate lines are removed;
a document is depleted if less than KEPT_SHARE of its words stay, with every occurrence of a removed line gone. n_removed_words
counts each removed line once. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import row_key

BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_DOCS, SHARE, KEPT_SHARE = 20, 0.01, 0.3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once even where ``use`` names it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return let(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def repeated_words(ws: Column) -> Column:
    """Words inside windows of WINDOW words that the text has at least twice. Windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        def of(pairs: Column) -> Column:
            same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
            starts = F.sort_array(F.transform(F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))
            first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"))
            return F.aggregate(starts, first, step, lambda acc: acc["n"])

        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of)

    repeats = lambda hashes: F.size(F.array_distinct(hashes)) < F.size(hashes)
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    counted = lambda w: let(windows(w), lambda h: F.when(repeats(h), covered(h)).otherwise(0))
    return let(ws, lambda w: F.when(F.size(w) > WINDOW, counted(w)).otherwise(0)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_measures(docs: DataFrame) -> DataFrame:
    """(row_key, host, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed); a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(
        row_key("doc_id", "text").alias("row_key"), F.xxhash64("source").alias("host"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words(text).alias("words")
    ).select(
        "row_key", "host", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(row_key, host, line, words, times): a document's distinct normalised lines with a word, and how often each stands in it.

    ``host`` hashes the source, null too.
    """
    lines = F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09\x0B-\x0D]+", " ")), "\n")
    entry = lambda line: F.struct(F.xxhash64(line).alias("line"), F.size(F.split(line, " ")).alias("words"))
    kept = F.filter(F.transform(lines, lambda x: F.btrim(x)), lambda x: x != "")

    def counted(entries: Column) -> Column:
        """Distinct entries with their numbers: equal ones stand side by side once sorted, each group's first place to the next's."""

        def of(xs: Column) -> Column:
            firsts = F.filter(F.transform(xs, lambda x, i: F.when(F.coalesce(F.get(xs, i - 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
            times = lambda at: F.transform(at, lambda i, k: F.struct(F.get(xs, i)["line"].alias("line"), F.get(xs, i)["words"].alias("words"), (F.coalesce(F.get(at, k + 1), F.size(xs)) - i).alias("times")))
            return let(firsts, times)

        return let(F.sort_array(entries), of)

    rows = docs.select(row_key("doc_id", "text").alias("row_key"), F.xxhash64("source").alias("host"), F.explode(counted(F.transform(kept, entry))).alias("entry"))
    return rows.select("row_key", "host", "entry.line", "entry.words", "entry.times")


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, line, n): lines above the limits. Counts are added up before the shuffle; few lines pass the fixed limit."""
    counts = line_hashes(docs).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    hosts = docs.groupBy(F.xxhash64("source").alias("host")).agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(hosts, "host").where(F.col("n") > F.col("docs") * share).select("host", "line", "n")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, kept_share: float = KEPT_SHARE) -> DataFrame:
    """Base measures of each row of ``docs`` (doc_id, text, source), its boilerplate lines, and whether it is kept.

    ``boilerplate`` has the hashes of the row's removed lines, ``n_gone_words`` the words that go with all their occurrences.
    Each row counts as a document of its host, also if it repeats another; repeated rows give repeated rows, and one that stands
    in two hosts is judged by the lines of each. Rows with a null source are one host. A text without words fails the base rules; long texts are measured whole. An empty table has no rows.
    """
    lines = line_hashes(docs)
    removed = lines.join(boilerplate(docs, min_docs, share).select("host", "line"), ["host", "line"])
    removed = removed.groupBy("row_key", "host").agg(F.collect_set(F.struct("line", "words", "times")).alias("removed"))
    joined = base_measures(docs).join(removed, ["row_key", "host"], "left")
    none = F.array().cast("array<struct<line:long,words:int,times:int>>")
    gone = lambda words: F.aggregate(F.coalesce("removed", none), F.lit(0).cast("long"), lambda n, x: n + words(x))
    judged = joined.withColumns({"n_removed_words": gone(lambda x: x["words"]), "n_gone_words": gone(lambda x: x["words"] * x["times"])})
    kept = ~F.col("base_failed") & (F.col("n_gone_words") <= F.col("n_words") * (1 - kept_share))
    return judged.select("*", kept.alias("kept"), F.coalesce(F.transform("removed", lambda x: x["line"]), F.array().cast("array<long>")).alias("boilerplate")).drop("removed")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The kept rows of ``docs``, all columns, their texts without boilerplate lines."""
    key, host = "_gradus_key", "_gradus_host"
    verdicts = judge(docs, **limits).where("kept").select(F.col("row_key").alias(key), F.col("host").alias(host), F.col("boilerplate").alias("_gradus_lines")).distinct()
    stays = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains("_gradus_lines", F.xxhash64(normalised(line))))
    joined = docs.withColumns({key: row_key("doc_id", "text"), host: F.xxhash64("source")}).join(verdicts, [key, host])
    return joined.withColumn("text", F.array_join(stays, "\n")).select(*docs.columns)


def quality_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns and the words on removed lines."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
