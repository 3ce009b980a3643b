"""Importance resampling towards a target: documents drawn by how their n-grams lean to the target's.

N-grams fall into buckets by their CRC-32. Each partition runs DuckDB over its rows, step by step: SQL
unnests the words, windows them into n-grams, and counts each document's buckets with zlib's CRC as a
registered function. The counts are spilled to Parquet; Spark merges them over all documents and over the
target, which gives one gain a bucket, and sums each document's gains where its counts lie, without a
shuffle. Gumbel noise from a hash of the id makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.index import dense_index
from .common import written

BUCKETS, NGRAM, SEED = 10_000, 1, 2024
#: Documents with fewer words aren't drawn; of the others, so many of a hundred are.
MIN_WORDS, DRAWN_PERCENT = 20, 10
#: Characters that DuckDB gets at once; a longer text goes in pieces.
STEP_CHARS = 2_000_000
DUCKDB_MEMORY = "400MB"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = str.maketrans(UPPER, LOWER)
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
MADE = "n_words long, n_features long, buckets array<int>, counts array<int>"


def crc32_of(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(t.encode("utf-8")) for t in texts.to_pylist()], pa.int64())


def count_sql(size: int, buckets: int) -> list[str]:
    """Statements over the view docs (k, text, carried): words, distinct n-grams' buckets, and counts by k.

    carried: words at the start of a piece that belong to the piece before it; n-grams of these alone aren't counted.
    """
    grams = ["SELECT k, word AS gram FROM words WHERE place > carried"]
    for j in range(2, size + 1):
        parts = "word" + "".join(f" || ' ' || lead(word, {i}) OVER w" for i in range(1, j))
        grams.append(f"SELECT k, {parts} AS gram FROM words WINDOW w AS (PARTITION BY k ORDER BY place) QUALIFY place + {j - 1} > carried AND gram IS NOT NULL")
    return [
        f"CREATE OR REPLACE TEMP TABLE words AS SELECT k, carried, unnest(found) AS word, generate_subscripts(found, 1) AS place FROM (SELECT k, carried, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS found FROM docs)",
        "CREATE OR REPLACE TEMP TABLE grams AS " + " UNION ALL ".join(grams),
        f"CREATE OR REPLACE TEMP TABLE hashed AS SELECT gram, (zlib_crc32(gram) % {buckets})::INTEGER AS bucket FROM (SELECT DISTINCT gram FROM grams)",
        "SELECT k, bucket, count(*)::INTEGER AS n FROM grams JOIN hashed USING (gram) GROUP BY k, bucket ORDER BY k, bucket",
    ]


def pieces(text: str, size: int, step: int = STEP_CHARS) -> Iterator[tuple[str, int]]:
    """(piece, words carried over from the one before): a long text cut between words."""
    at, carried = 0, []
    while True:
        end = len(text)
        if end - at > step:
            found = _BETWEEN.search(text, at + step)
            end = found.start() if found else end
        yield " ".join([*carried, text[at:end]]), len(carried)
        if end >= len(text):
            return
        if size > 1:
            carried = [*carried, *re.findall(WORD, text[at:end].translate(_LOWERED))][1 - size :]
        at = end


def partition_counter(size: int, buckets: int):
    """A function from (row, text) pairs to rows of (n_words, bucket array, count array), in order, through one DuckDB."""
    import duckdb

    connection = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
    connection.execute("SET temp_directory = ''")
    connection.create_function("zlib_crc32", crc32_of, ["VARCHAR"], "BIGINT", type="arrow")
    statements = count_sql(size, buckets)

    def step(rows: list[tuple[int, str, int]]):
        """Per piece (place in rows): words, and (k, bucket, n) columns."""
        table = pa.table({"k": pa.array(range(len(rows)), pa.int64()), "text": pa.array([t for _, t, _ in rows], pa.large_string()), "carried": pa.array([c for _, _, c in rows], pa.int64())})
        connection.register("docs", table)
        for s in statements[:-1]:
            connection.execute(s)
        found = connection.sql(statements[-1]).fetchnumpy()
        words = connection.sql("SELECT k, count(*) FILTER (place > carried) AS n FROM words GROUP BY k").fetchnumpy()
        connection.unregister("docs")
        n_words = np.zeros(len(rows), np.int64)
        n_words[words["k"]] = words["n"]
        return n_words, np.searchsorted(found["k"], np.arange(len(rows) + 1)), np.asarray(found["bucket"], np.int32), np.asarray(found["n"], np.int32)

    def count(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(n_words, n_features, buckets, counts) of each text."""
        held: list[tuple[int, str, int]] = []
        chars, open_row = 0, None

        def flushed() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            nonlocal open_row
            if not held:
                return
            n_words, ends, bucket, n = step(held)
            for i, (row, _, _) in enumerate(held):
                own = (n_words[i], bucket[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]])
                if open_row and open_row[0] == row:
                    both, where = np.unique(np.concatenate([open_row[2], own[1]]), return_inverse=True)
                    total = np.zeros(len(both), np.int64)
                    np.add.at(total, where, np.concatenate([open_row[3], own[2]]))
                    own = (open_row[1] + own[0], both, total)
                elif open_row:
                    yield open_row[1], int(open_row[3].sum()), open_row[2], open_row[3]
                open_row = (row, *own)
            held.clear()

        for row, text in enumerate(texts):
            for piece, carried in pieces(text or "", size):
                if chars + len(piece) > STEP_CHARS and held:
                    yield from flushed()
                    chars = 0
                held.append((row, piece, carried))
                chars += len(piece)
        yield from flushed()
        if open_row:
            yield open_row[1], int(open_row[3].sum()), open_row[2], open_row[3]

    return count


def bucket_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """The columns keep of docs, n_words, n_features, and the buckets (ascending) of each text's features with
    their counts, spilled to Parquet. Null and empty texts have none; a very long text is counted in pieces."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = partition_counter(ngram, buckets)
        for batch in batches:
            found = list(count(batch.column(batch.num_columns - 1).to_pylist()))
            if not found:
                continue
            ends = np.cumsum([0, *[len(b) for _, _, b, _ in found]]).astype(np.int32)
            made = [
                pa.array([w for w, _, _, _ in found], pa.int64()),
                pa.array([f for _, f, _, _ in found], pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([b for _, _, b, _ in found]), pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([n for _, _, _, n in found]).astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    own = docs.select(*[F.col(f"`{c}`") for c in keep])
    names = [*keep, "n_words", "n_features", "buckets", "counts"]
    schema = ", ".join([f"`{c}` {kind}" for c, kind in own.dtypes] + [MADE])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    return written(rows.mapInArrow(counted, schema), "bucket-counts")


def merged_counts(counted: DataFrame) -> DataFrame:
    """(bucket, n) over all rows; a task sums up its own rows first."""
    each = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).select(F.col("x.buckets").alias("bucket"), F.col("x.counts").alias("c"))
    return each.groupBy("bucket").agg(F.sum("c").alias("n"))


def bucket_gains(counted: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): a thousand times the log of the target's smoothed share over that of all rows, rounded down."""
    both = merged_counts(counted).withColumnRenamed("n", "s").join(merged_counts(target).withColumnRenamed("n", "t"), "bucket", "full")
    every = counted.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(both, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    filled = written(filled, "bucket-totals")
    totals = filled.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(totals["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(totals["t"] + buckets))
    return filled.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandfold of Gumbel noise from the id, rounded down; a null id counts as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_resample(
    docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = DRAWN_PERCENT, seed: int = SEED
) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, text_hash, n_words, n_features, weight, score, rank, all long.

    target (text): texts that docs are drawn towards. Features are the runs of 1 to ngram words, repeats
    counted. weight sums the gains of a document's features; score adds noise; of the N documents with at
    least min_words words the floor(percent * N / 100) highest scores are drawn and numbered, ties by the
    smaller doc_id, a null one first; rank is null for the others.

    A null or empty text has no feature and weight 0. Rows that repeat a doc_id are documents with equal
    noise; if they repeat the text too, which of them is ranked first is open. A very long text is counted
    in pieces without losing an n-gram. An empty target makes all gains depend on docs alone; an empty
    table gives no rows. Columns besides doc_id and text aren't read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), "text")
    counted = bucket_counts(own, ("doc_id", "text_hash"), ngram=ngram, buckets=buckets)
    wanted = bucket_counts(target.select("text"), (), ngram=ngram, buckets=buckets)
    gains = written(bucket_gains(counted, wanted, buckets), "bucket-gains")
    # one number a bucket, as many as the parameter says
    table = gains.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains")).scalar()
    each = F.zip_with("buckets", "counts", lambda b, n: F.get(F.col("_gains"), b) * n)
    weighed = counted.withColumn("_gains", table).withColumn("weight", F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x))
    noisy = weighed.select("doc_id", "text_hash", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"))
    scored = written(noisy, "resample-scored")
    wide = F.col("n_words") >= min_words
    drawn = scored.agg(F.expr(f"{percent} * count_if(n_words >= {min_words}) div 100")).scalar()
    placed = dense_index(scored, [~wide, -F.col("score"), F.col("doc_id")], "_place")
    return placed.withColumn("rank", F.when(F.col("_place") < drawn, F.col("_place") + 1)).drop("_place")


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of docs that were drawn, all columns; rows that repeat doc_id and text go together."""
    chosen = ranked.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn_id"), F.col("text_hash").alias("_drawn_hash"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_drawn_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_drawn_hash"))
    return docs.join(chosen, same, "left_semi")


#: DuckDB SQL with the rows of the query over documents and benchmark. It has no CRC-32: the table of 256 and
#: the sum over a word's bytes are spelled out, for distinct words.
ORACLE = rf"""
WITH RECURSIVE shifted(i, step, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM shifted WHERE step < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tab FROM shifted WHERE step = 8
), words AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
  UNION ALL SELECT 'b', NULL, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') FROM benchmark
), counted AS (
  SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(w) AS word FROM words) GROUP BY ALL
), bytes AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bytes, crc
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM counted JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM totals) + {BUCKETS}))))::BIGINT AS gain FROM totals
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(gain * n)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {DRAWN_PERCENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
