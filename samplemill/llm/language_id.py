"""Language identification by compression.

Each language has a raw-content dictionary for zstandard: lines of a bounded sample of labelled
documents. A text is compressed once with each dictionary, in blocks so that the dictionary counts
from first to last byte; the language whose dictionary makes it smallest is predicted, and rejected
where the next one comes too close. Texts and dictionaries are lower-cased, and whatever stands
between letters counts as a blank. A close result is settled by compressing once more at a level
that searches for the best matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unused, use_memo, written

#: Bounds of what a language learns from: documents, and bytes of their lines.
SAMPLE_DOCUMENTS = 400
DICTIONARY_BYTES = 112 * 1024
#: Bytes of all dictionaries: with more languages than fit, each has a smaller one.
TOTAL_BYTES = 200 * DICTIONARY_BYTES
#: Longer lines are learned in pieces of so many characters.
LINE_CHARS = 1000
BLOCK_BYTES = 4096
#: Level of the first look, and of the second where the next language is within SECOND_LOOK of the best.
LEVEL, BEST_LEVEL = 3, 19
SECOND_LOOK = 0.03
#: Rejected if the next language needs less than so many bytes more, absolutely or a byte of the best.
MARGIN_BYTES = 1
MARGIN_SHARE = 0.004
UNKNOWN = "und"

_BETWEEN = re.compile(r"[\W\d_]+")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % modulus


def learn_dictionaries(labelled: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, dictionary_bytes: int = DICTIONARY_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, the most frequent first, from labelled (text, lang); rows with null or empty text or lang are left out.

    The sample is drawn by a hash of the text: at most sample_documents distinct texts of a language, and
    of the distinct pieces of their lines at most dictionary_bytes (one piece at least). Every language is
    learned; where their dictionaries would exceed total_bytes together (more than 200 languages by default), each
    has an equal share of these, as all are held by each worker.
    """
    rows = labelled.filter("lang is not null and text is not null and text != ''").select("lang", "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts"))
    counts = written(counts, "language-counts")
    dictionary_bytes = min(dictionary_bytes, total_bytes // max(counts.count(), 1))
    # twice as many as wanted by a threshold on the hash, then the first of these by rank
    drawn = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)).alias("draw")
    near = rows.join(F.broadcast(counts), "lang").select("lang", "text", "texts", drawn).filter(F.col("draw") < F.lit(float(2 * sample_documents << 30)) / F.col("texts"))
    near = near.select("lang", "text", "draw").distinct()
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("rank") <= sample_documents)
    pieces = F.regexp_extract_all("line", F.lit(f"(?s).{{1,{LINE_CHARS}}}"), F.lit(0))
    lines = ranked.select("lang", F.explode(F.split("text", "\n")).alias("line")).select("lang", F.explode(pieces).alias("line")).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("line"), "line")
    upto = lines.withColumn("upto", F.sum(F.octet_length("line") + 1).over(order)).withColumn("place", F.row_number().over(order))
    taken = upto.filter((F.col("upto") <= dictionary_bytes) | (F.col("place") == 1))
    whole = taken.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("upto", "line"))), lambda x: x["line"]), "\n").alias("content"))
    found = whole.join(F.broadcast(counts), "lang").orderBy(F.desc("n"), "lang").collect()
    return {r["lang"]: letters(r["content"]).encode() for r in found}


@cache
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list:
    import zstandard

    out = []
    for _, content in dictionaries:
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        given.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=given, write_content_size=False, write_checksum=False))
    return out


def forget_compressors() -> None:
    _compressors.cache_clear()


def letters(text: str) -> str:
    """The text's letters and marks, lower-cased, with one blank for all that stands between."""
    return _BETWEEN.sub(" ", text.lower()).strip()


def compressed_sizes(text: str, dictionaries: tuple[tuple[str, bytes], ...], level: int = LEVEL, block: int = BLOCK_BYTES) -> list[int]:
    """Bytes of the whole text with each dictionary."""
    data = text.encode("utf-8", "surrogatepass")
    blocks = [data[at : at + block] for at in range(0, len(data), block)]
    return [sum(len(c.compress(b)) for b in blocks) for c in _compressors(dictionaries, level)]


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], margin_bytes: int = MARGIN_BYTES, margin_share: float = MARGIN_SHARE) -> tuple[str, float, bool]:
    """(language, score, rejected) of a text; equal sizes go to the first."""
    if not dictionaries or not text or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    text = letters(text)
    sizes = compressed_sizes(text, dictionaries)
    least = min(sizes)
    if len(sizes) > 1 and sorted(sizes)[1] <= least * (1 + SECOND_LOOK) + MARGIN_BYTES:
        sizes = compressed_sizes(text, dictionaries, BEST_LEVEL)
        least = min(sizes)
    score = 1 / sum(2.0 ** -min(s - least, 64) for s in sizes)
    margins = [s - least for k, s in enumerate(sizes) if k != sizes.index(least)]
    close = bool(margins) and (min(margins) < margin_bytes or min(margins) < margin_share * least)
    return dictionaries[sizes.index(least)][0], score, close


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], margin_bytes: int = MARGIN_BYTES, margin_share: float = MARGIN_SHARE) -> DataFrame:
    """docs (text, ...) with lang_pred (a learned language, or und), score (0 to 1) and rejected.

    und, score 0 and rejected: a text that is null or has no letter, or no language was learned.
    Equal sizes go to the language that was learned from most documents and are rejected; where only one
    was learned, nothing comes close to it. Very long texts are compressed
    whole, block by block. Columns of docs named like those added are replaced; all others stay.
    """
    learned = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))

    @F.pandas_udf("struct<lang_pred:string, score:double, rejected:boolean>")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        use_memo("language_id", forget_compressors)
        for some in texts:
            yield pd.DataFrame([classify(t, learned.value, margin_bytes, margin_share) for t in some], columns=["lang_pred", "score", "rejected"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    # a filter on the result must not run the compression twice
    (made,) = unused(docs, "_found")
    found = docs.select(*kept, predict.asNondeterministic()(F.col("text").cast("string")).alias(made))
    return found.select(*kept, *[F.col(made)[c].alias(c) for c in ("lang_pred", "score", "rejected")])


def training_rows(docs: DataFrame) -> DataFrame:
    """The labelled documents that the language query and the pipeline learn from."""
    return docs.filter(remainder(F.col("doc_id"), 4) != 2)
