"""How five filters interact: what each removes in every order in which they can be applied.

Words are exploded and aggregated by (document, word), then by document for totals and distinct words; the flags that need no
words, the copies and the labels are joined to them. A document is then a mask of the filters it fails. One aggregation of 32
conditional counts a part (and as many for good and for toxic documents) holds all that the 120 orders need: what an order
keeps, removes and finds removed already are sums over masks. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import row_key

#: Filter k fails a document by bit k of its mask.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 100, 80, 10, r"[#$%&*|]"
#: Partitions of exploded words for each shuffle partition: small ones keep the map of a task's words in cache.
SPREAD = 4
#: Rows that have one text are joined to its first id over so many keys.
SALTS = 16

ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _spaced(text: Column) -> Column:
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def word_totals(docs: DataFrame) -> DataFrame:
    """(row_key, n_words, n_distinct) of each different (doc_id, text) of ``docs``; words are told apart by 64-bit hashes.

    A row is dealt whole, by its key, before its words are exploded, so no word is shuffled. A null entry beside the words
    counts a row's repeats.
    """
    partitions = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(row_key("doc_id", "text").alias("row_key"), _spaced(F.coalesce("text", F.lit(""))).alias("text"))
    entries = F.explode(F.concat(F.split("text", " "), F.array(F.lit(None).cast("string")))).alias("word")
    words = rows.repartition(partitions, "row_key").select("row_key", entries).where("word is null or word <> ''")
    hashed = F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("word")
    counts = words.select("row_key", hashed).groupBy("row_key", "word").agg(F.count(F.lit(1)).alias("n"))
    is_word = F.col("word").isNotNull()
    total, repeats = F.sum(F.when(is_word, F.col("n"))), F.max(F.when(~is_word, F.col("n")))
    return counts.groupBy("row_key").agg(
        F.coalesce((total / repeats).cast("long"), F.lit(0)).alias("n_words"), F.count("word").alias("n_distinct")
    )


def first_of_copies(rows: DataFrame) -> DataFrame:
    """(text_a, text_b, salt, first): the smallest doc_id of each text that rows of several ids have, once for each salt."""
    groups = rows.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return groups.select("text_a", "text_b", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for each row of ``docs``: the filters that it fails, and what its labels say."""
    text = F.coalesce("text", F.lit(""))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]++", ""))
    rows = docs.select(
        row_key("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.xxhash64(text).alias("text_a"), F.xxhash64(text, F.lit(1)).alias("text_b"),
        (100 * capitals > MAX_CAPITALS_PERCENT * F.length(text)).alias("c"), text.rlike(SYMBOLS).alias("d"),
    )
    salt = F.coalesce(F.pmod(F.hash("doc_id"), F.lit(SALTS)), F.lit(0)).cast("int")
    copies = first_of_copies(rows)
    marked = rows.withColumn("salt", salt).join(copies, ["text_a", "text_b", "salt"], "left").join(word_totals(docs), "row_key", "left")
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    n, distinct = (F.coalesce(c, F.lit(0)) for c in ("n_words", "n_distinct"))
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, F.col("c"), F.col("d"), F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")
    return marked.join(said, "doc_id", "left").select(
        "part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )


def mask_counts(masked: DataFrame) -> DataFrame:
    """A row for each part: arrays ``n``, ``good`` and ``toxic`` of 32 conditional counts, by mask."""
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.count_if((F.col("mask") == m) & of).alias(f"{kind}_{m}") for kind, of in kinds.items() for m in range(MASKS)]
    per = masked.groupBy("part").agg(*counts)
    return per.select("part", *[F.array(*[F.col(f"{kind}_{m}") for m in range(MASKS)]).alias(kind) for kind in kinds])


def _total(counts: str, use: Callable[[Column], Column]) -> Column:
    """The sum of ``counts`` over the masks for which ``use`` holds."""
    entries = F.transform(F.col(counts), lambda n, m: F.when(use(m), n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(entries, F.lit(0).cast("long"), lambda a, b: a + b)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic): a row for each part, order and step.

    Filters: A fewer than 100 words; B distinct words under 80 % of words; C capitals A-Z over 10 % of code points; D a symbol;
    E the text of a row with a smaller doc_id. ``kept`` rows pass this and all earlier steps, ``removed`` fail this step first,
    ``redundant`` fail it after an earlier one, ``unique_fails`` fail nothing else; ``shapley`` is the filter's removed rows
    over all orders. A null text is empty, a null lang the part ''. A null doc_id is no copy's first, no copy and has no
    labels; of rows with equal id and text none is the other's copy. A document is good or toxic if any of its labels says so.
    Long texts are split whole. An empty table has no parts and so no rows.
    """
    per = mask_counts(masks(docs, labels))
    steps = per.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS])))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    return _counted(steps.select("*", _own_bit().alias("own"), _bits_so_far().alias("upto")))


def _own_bit() -> Column:
    """The bit of the step's filter."""
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    return F.element_at(F.create_map(*[x for k, f in enumerate(FILTERS) for x in (F.lit(f), F.lit(1 << k))]), letter)


def _bits_so_far() -> Column:
    """The bits of the filters up to the step's, its own included."""
    bits = [F.when(F.instr("filter_order", f) <= F.col("step"), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)]
    return sum(bits, F.lit(0))


def _counted(steps: DataFrame) -> DataFrame:
    own, upto = F.col("own"), F.col("upto")
    has = lambda m: m.bitwiseAND(own) != 0
    earlier = lambda m: m.bitwiseAND(upto - own) != 0
    first = lambda m: has(m) & ~earlier(m)
    share = F.transform(F.col("n"), lambda n, m: F.when(has(m), n * (len(ORDERS) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return steps.select(
        "part", "filter_order", "step", _total("n", lambda m: m.bitwiseAND(upto) == 0).alias("kept"), _total("n", first).alias("removed"),
        _total("n", lambda m: has(m) & earlier(m)).alias("redundant"), F.get("n", own).alias("unique_fails"), _total("good", first).alias("good_lost"),
        _total("toxic", first).alias("toxic_lost"), F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )
