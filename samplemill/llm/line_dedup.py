"""Line deduplication by winnowing, in DataFrame functions only.

Each line is hashed. Over every window of lines that just reaches `min_words` words, the smallest
line hash is selected as a fingerprint: two documents that share a run of lines with that many words
share a whole window, and so select the same fingerprint. Positions whose fingerprint stands nowhere else are
dropped, and with them every window that selected it. The windows of a position that is left are matched with the
earliest windows of the same lines, which are windows of the same fingerprint: not each pair of a fingerprint's
positions, as a common line has too many, but each position with the earliest one that agrees around it.
The windows that start and those that end at each line extend a match both ways, to the last line that is
equal; windows that agree with an earlier one are merged to runs, and the lines of these later runs are deleted.

Only hashes of 128 bits are shuffled for this. A window is matched against the first of its kind, never
against each copy, so a line or passage in a third of all documents costs a row for each occurrence; and
keys with so many rows are joined by broadcasting their few rows of the other side, so that the occurrences
stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unused, written

MIN_WORDS = 50
#: A key with more than this part of all rows is joined by broadcast: there are fewer such keys than this.
HEAVY_PARTS = 1000
_WORD = r"[^ \t-\r]+"
_ROW = ["row_doc", "row_text"]


def _lines(docs: DataFrame) -> DataFrame:
    """A row a line with words: the row's key, pos, a and b (its hash, in two halves), and the words before
    and up to it."""
    line = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    rows = docs.select(F.col("doc_id").alias("row_doc"), _text_key(), "text").select(*_ROW, line)
    bare = F.btrim("line", F.lit(" \t\r"))
    hashed = rows.select(*_ROW, "pos", F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"), F.regexp_count("line", F.lit(_WORD)).cast("long").alias("words")).filter("words > 0")
    # rows that repeat one another are the same document
    once = hashed.groupBy(*_ROW, "pos").agg(*[F.first(c).alias(c) for c in ("a", "b", "words")])
    upto = F.sum("words").over(Window.partitionBy(*_ROW).orderBy("pos"))
    return once.withColumn("word_end", upto).withColumn("word_start", F.col("word_end") - F.col("words"))


def _text_key() -> Column:
    return F.xxhash64("text").alias("row_text")


def _frames(min_words: int):
    """The frames of the windows that start at a line and of those that end at it."""
    own = Window.partitionBy(*_ROW)
    return own.orderBy("word_start").rangeBetween(0, min_words - 1), own.orderBy("word_end").rangeBetween(1 - min_words, 0)


def _selected(lines: DataFrame, min_words: int) -> DataFrame:
    ahead, _ = _frames(min_words)
    least = F.min(F.struct("a", "b", "pos")).over(ahead).alias("least")
    enough = (F.max("word_end").over(ahead) - F.col("word_start") >= min_words).alias("enough")
    return lines.select(*_ROW, least, enough).filter("enough").select(*_ROW, F.struct("least.a", "least.b").alias("fingerprint"), F.col("least.pos").alias("fingerprint_pos")).distinct()


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The selected fingerprints: row_doc, row_text, fingerprint, fingerprint_pos."""
    return _selected(_lines(docs), min_words)


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Windows of min_words words at least that start or end at a line: the row's key, first, last, content
    (hash of the lines), fingerprint_pos."""
    ahead, behind = _frames(min_words)
    item = F.struct("a", "b", "pos", "word_start", "word_end")
    both = lines.select(*_ROW, "pos", "word_start", "word_end", F.collect_list(item).over(ahead).alias("after"), F.collect_list(item).over(behind).alias("before"))
    both = both.withColumn("least", F.array_min(F.transform("after", lambda x: F.struct(x["a"], x["b"], x["pos"].alias("pos"))))["pos"])
    # a window that ends here is anchored by the fingerprint of the window that starts at its first line
    both = both.withColumn("anchor", F.first("least").over(behind))

    def window(items: str, anchor: str) -> Column:
        first, last = F.element_at(items, 1), F.element_at(items, -1)
        content = F.struct(F.xxhash64(F.transform(items, lambda x: x["a"])).alias("a"), F.xxhash64(F.transform(items, lambda x: x["b"])).alias("b"))
        return F.struct((last["word_end"] - first["word_start"]).alias("words"), first["pos"].alias("first"), last["pos"].alias("last"), content.alias("content"), F.col(anchor).alias("fingerprint_pos"))

    return both.select(*_ROW, F.inline(F.array(window("after", "least"), window("before", "anchor")))).filter(F.col("words") >= min_words).drop("words")


def join_first(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the value that table (key, value, n: how many rows there are of each key) has for their key,
    a hash in two halves; rows without one are left out.

    Keys with more than a part in HEAVY_PARTS of all rows of the table are fewer than HEAVY_PARTS: their rows
    of table are broadcast, and their rows of `rows` go through the join of all other keys under a hash of
    their own.
    """
    total = table.agg(F.sum("n").alias("t")).scalar()
    heavy = F.broadcast(table.filter(F.col("n") * HEAVY_PARTS > total).limit(HEAVY_PARTS).select(F.col(key).alias("_heavy_key"), F.col(value).alias("_heavy")))
    light = table.select(F.col(key).alias("_light_key"), F.col(value).alias("_light"))
    spread = F.xxhash64(*rows.columns)
    other = F.struct(spread.alias("a"), spread.alias("b"))
    given = rows.join(heavy, F.col(key) == F.col("_heavy_key"), "left").withColumn("_join", F.when(F.col("_heavy_key").isNull(), F.col(key)).otherwise(other))
    found = given.join(light, F.col("_join") == F.col("_light_key"), "left").withColumn(value, F.coalesce("_heavy", "_light"))
    return found.filter(F.col(value).isNotNull()).select(*rows.columns, value)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The later copies of repeated runs of lines: row_doc, row_text, runs (sorted [first, last] structs)."""
    # tables of hashes: each is read several times below
    lines = written(_lines(docs), "lines")
    selected = written(_selected(lines, min_words), "line-fingerprints")
    repeated = selected.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("elsewhere")).filter("n > 1")
    hits = written(join_first(selected, repeated, "fingerprint", "elsewhere").select(*_ROW, "fingerprint_pos"), "line-hits")
    same_row = lambda a, b: a["row_doc"].eqNullSafe(b["row_doc"]) & (a["row_text"] == b["row_text"])
    rows = hits.select(*_ROW).distinct()
    windows = _windows(lines.join(rows, same_row(lines, rows), "left_semi"), min_words)
    near = windows.join(hits, same_row(windows, hits) & (windows["fingerprint_pos"] == hits["fingerprint_pos"]), "left_semi").drop("fingerprint_pos")
    near = written(near, "line-windows")
    place = F.struct("row_doc", "row_text", "first")
    earliest = near.groupBy("content").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = join_first(near, earliest, "content", "earliest").filter(place > F.col("earliest")).select(*_ROW, "first", "last").distinct()
    order = Window.partitionBy(*_ROW).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = later.withColumn("new", (reach.isNull() | (F.col("first") > reach + 1)).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(order)).groupBy(*_ROW, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _removed(runs: Column, pos: Column) -> Column:
    return F.exists(runs, lambda r: (r["first"] <= pos) & (pos <= r["last"]))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Delete later copies of runs of lines with min_words words or more from docs (doc_id, text, ...).

    Returns the columns of docs, text without the deleted lines, and n_lines, removed_lines (long)
    and removed_runs (text such as "3-5,9-9": line numbers from 0). Earlier means a smaller doc_id
    (null first), then a smaller line number. A line goes if it stands in a window of lines that
    agrees with an earlier window; overlapping repeats within a document keep their first line.

    A null text stays null with no lines; an empty text has one empty line. Lines are compared
    without blanks, tabs and carriage returns at their ends; lines without words count for nothing
    and go only from inside a run. Rows that agree in doc_id and text are one document and keep the
    same lines. An empty table gives an empty result. Columns of docs named like those returned
    are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "removed_lines", "removed_runs")]
    row_doc, row_text, found, text_key = unused(docs, "_row_doc", "_row_text", "_runs", "_text_key")
    runs = repeated_runs(docs.select("doc_id", "text"), min_words).select(F.col("row_doc").alias(row_doc), F.col("row_text").alias(row_text), F.col("runs").alias(found))
    keyed = docs.select(*kept).withColumn(text_key, F.xxhash64("text"))
    joined = keyed.join(runs, (F.col("doc_id").eqNullSafe(F.col(row_doc))) & (F.col(text_key) == F.col(row_text)), "left")
    lines = F.split("text", "\n")
    cleaned = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda line, i: ~_removed(F.col(found), i)), "\n"))
    total = F.aggregate(found, F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    return joined.select(
        *[cleaned.alias("text") if c == "text" else F.col(c) for c in kept],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(total, F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce(F.array_join(F.transform(found, lambda r: F.concat_ws("-", r["first"], r["last"])), ","), F.lit("")).alias("removed_runs"),
    )


#: DuckDB SQL with the rows of dedup_lines over documents: doc_id, text, n_lines, removed_lines, removed_runs.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, str_split(text, chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS pos FROM split
), lines AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line,
         len(regexp_extract_all(line, '[^ \t-\r]+'))::BIGINT AS words FROM numbered
), ends AS (
  SELECT *, (sum(words) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS word_end FROM lines WHERE words > 0
), spans AS (
  SELECT *, word_end - words AS word_start FROM ends
), windows AS (
  SELECT doc_id, pos AS f, max(pos) OVER a AS l, max(word_end) OVER a - word_start AS n, list(line) OVER a AS content
  FROM spans WINDOW a AS (PARTITION BY doc_id ORDER BY word_start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER b, pos, word_end - min(word_start) OVER b, list(line) OVER b
  FROM spans WINDOW b AS (PARTITION BY doc_id ORDER BY word_end RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), ranked AS (
  SELECT doc_id, f, l, rank() OVER (PARTITION BY content ORDER BY doc_id, f) AS place FROM windows WHERE n >= 50
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(f, l + 1)) AS pos FROM ranked WHERE place > 1
), islands AS (
  SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone
), runs AS (
  SELECT doc_id, min(pos) AS f, max(pos) AS l FROM islands GROUP BY doc_id, island
), removed AS (
  SELECT doc_id, string_agg(f || '-' || l, ',' ORDER BY f) AS removed_runs, sum(l - f + 1)::BIGINT AS removed_lines FROM runs GROUP BY doc_id
), kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) AS text
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.pos = n.pos WHERE g.pos IS NULL GROUP BY n.doc_id
)
SELECT d.doc_id,
       CASE WHEN r.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       coalesce(len(str_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(r.removed_lines, 0)::BIGINT AS removed_lines,
       coalesce(r.removed_runs, '') AS removed_runs
FROM documents d LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
