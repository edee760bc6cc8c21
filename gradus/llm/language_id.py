"""Language identification by compression with one raw-content zstandard dictionary per language.

A language's dictionary is plain text of a bounded sample of its labelled documents. A whole text, in chunks short enough for
the dictionary to matter in each, is compressed with every dictionary; the smallest total names the language, and the relative
margin to the next one is the score. Texts whose margin is narrow are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import as_bytes, let_go, row_key, without

UNKNOWN = "und"
#: The sample: at most DICTIONARY bytes of a language's labelled texts, one passage of at most EXCERPT characters of each.
DICTIONARY, EXCERPT = 64 << 10, 2048
CHUNK, LEVEL = 512, 6
#: Margins below this are rejected.
NARROW = 0.004

PREDICTED = "row_key long, doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def with_letter(text: Column) -> Column:
    """Whether ``text`` has a letter (Unicode category L; number signs are none); false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample_dictionaries(labelled: DataFrame, size: int = DICTIONARY, excerpt: int = EXCERPT) -> dict[str, bytes]:
    """A dictionary for each value of lang in ``labelled`` (lang, text; neither null).

    A text gives one passage, the whole text or ``excerpt`` characters from a place that its hash sets, so that one long text
    does not fill a dictionary. Passages of distinct texts are taken by the order of a hash until the dictionary is full.
    They are drawn at a rate set by the bytes of all of their language's passages, so that about four times as much as fills
    the dictionary reaches the driver, whatever the corpus's size and however often a text is repeated in it. A language with
    less than that gives all of its passages: none is lost.
    """
    place = F.xxhash64("text")
    first = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - excerpt, F.lit(0)) + 1).cast("int") + 1
    labelled = labelled.select("lang", place.alias("place"), F.substr("text", first, F.lit(excerpt)).alias("text"))
    once = labelled.select("lang", "place", (F.octet_length("text") + 1).alias("bytes")).distinct()
    counts = {r.lang: r.bytes for r in once.groupBy("lang").agg(F.sum("bytes").alias("bytes")).collect()}  # a row for each language
    if not counts:
        return {}
    wanted = 4 * size + 64 * excerpt
    rates = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, wanted / n)))])
    drawn = labelled.where(F.pmod("place", F.lit(1 << 30)) < rates[F.col("lang")] * F.lit(1 << 30))
    texts: dict[str, bytes] = {lang: b"" for lang in counts}
    for r in drawn.distinct().orderBy("lang", "place", "text").collect():
        if len(texts[r.lang]) < size:
            texts[r.lang] += r.text.encode().lower() + b"\n"
    return {lang: text[:size] for lang, text in texts.items() if text}


def training_rows(docs: DataFrame) -> DataFrame:
    """(lang, text) of the labelled documents outside the held-out fold that have letters."""
    return docs.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & with_letter(F.col("text"))).select("lang", "text")


def classify(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): predicted language, score from 0 to 1, whether it is rejected.

    A null text, or one without letters, is ``und`` with score 0 and rejected; so is every text if there is no dictionary.
    With one dictionary every other text is that language's, with score 1. Equal sizes go to the first name, with score 0.
    A null id is in no fold and so not held out. Repeated rows give repeated rows; an empty table has none. Long texts are
    compressed whole, chunk by chunk.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        compressors = []
        for lang, text in shared.value:
            raw = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            compressors.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False).compress))
        for batch in batches:
            found = [_predict(t, compressors) for t in as_bytes(batch.column("text"))]
            columns = [batch.column(c) for c in ("row_key", "doc_id", "held_out")]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            rejected = pa.array([lang == UNKNOWN or score < narrow for lang, score in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns, rejected], names=[c.split()[0] for c in PREDICTED.split(", ")])

    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    lettered = F.when(with_letter(F.col("text")), F.col("text"))
    rows = docs.select(row_key("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), lettered.alias("text"))
    return rows.mapInArrow(predict, PREDICTED)


def _predict(text: bytes | None, compressors: list) -> tuple[str, float]:
    if not text or not compressors:
        return UNKNOWN, 0.0
    text = text.lower()
    chunks = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]
    sizes = sorted((sum(len(compress(c)) for c in chunks), lang) for lang, compress in compressors)
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def identify(docs: DataFrame) -> DataFrame:
    """Learns from ``docs`` (doc_id, text, lang) outside the held-out fold and classifies all of it.

    Every language with a labelled text that has letters is learned, if only from one repeated text. Without any, all is ``und``.
    """
    return classify(docs, sample_dictionaries(training_rows(docs)))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected; other rows and all columns unchanged.

    Rows that repeat a rejected one go with it. Texts are judged as ``classify`` says: null ones and those without letters go.
    """
    return without(docs, identify(docs).where("rejected"))
