"""Registered queries that write files from the tables and read them back, and queries through a whole pipeline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import tensor as tn
from .functions import text as tx
from .functions.index import dense_index
from .functions.shared import new_folder
from .functions.stores import write_file
from .functions.templates import ChatTemplate
from .operators import order, paths, subwords, tags, tokens
from .plans.pipeline import Pipeline
from .queries import SEED, _COLOURS, _drop_sql, documents, images, query, run, u, values
from .sources import files, sinks


def write_files(rows: DataFrame) -> None:
    """A file for each row (path, content)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                write_file(path, bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()


def byte(v):
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 32 * v.cast("double")))).cast("int")


_BYTE = "floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 128 + 32 * v)))"

# ---- images: written in the format of their names, read again

_BLOCKS = "WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(0, len(embedding)))::INTEGER AS pos FROM embeddings)"


@query("save_load_jpeg", f"{_BLOCKS} SELECT vec_id, pos, {_BYTE}::BIGINT AS low, {_BYTE}::BIGINT AS high FROM e")
def save_load_jpeg(spark, sf_dir):
    """Each value a block of 8 x 8 grey pixels, which a JPEG keeps exactly; eight blocks in a line, as many lines as the
    values need. The blocks are read off each image where it is, by vec_id and the values' hash in the file's name."""
    folder, side, n = new_folder(spark, "jpeg"), 64, F.size("embedding")
    named = F.concat(F.col("vec_id").cast("string"), F.lit("-"), F.hex(F.xxhash64("embedding")))
    rows = images(spark, sf_dir).filter(n > 0).withColumns({"name": named, "path": F.concat(F.lit(f"{folder}/"), named, F.lit(".jpg"))})
    lines, eight = F.ceil(n / 8).cast("int"), lambda v: F.array_repeat(v, 8)
    greys = F.concat(F.transform("embedding", lambda v: byte(v) / 255), F.array_repeat(F.lit(0.0), lines * 8 - n))
    line = lambda values, k: F.flatten(F.transform(F.slice(values, k * 8 + 1, 8), eight))
    pixels = tx.bound(greys, lambda values: F.flatten(F.transform(tn.indices(lines), lambda k: F.flatten(eight(line(values, k))))))
    run(rows.withColumn("image", tn.tensor(F.array(F.lit(1), lines * 8, F.lit(side)), pixels)), sinks.SaveImage("image", "path", folder, 0.0, 1.0))
    back = rows.withColumn("path", F.concat(F.lit(f"{folder}/epoch-0/"), F.col("idx").cast("string"), F.lit("-"), F.col("name"), F.lit("-image.jpg"))).drop("image")
    loaded = run(back, files.LoadImage("path", "image", 0.0, 255.0, [".jpg"], channels=1))
    each = loaded.select("vec_id", "image.data", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    start = lambda y: (F.floor(F.col("pos") / 8).cast("int") * 8 + y) * side + F.col("pos") % 8 * 8 + 1
    block = F.concat(*[F.slice("data", start(y), 8) for y in range(8)])
    return each.select("vec_id", "pos", *[F.round(of(block)).cast("long").alias(end) for end, of in (("low", F.array_min), ("high", F.array_max))])


@query("save_load_png", f"WITH e AS (SELECT vec_id, {_COLOURS} AS x FROM embeddings), d AS (SELECT vec_id, unnest(x) AS v, unnest(range(0, len(x)))::INTEGER AS pos FROM e) SELECT vec_id, pos, round((({_BYTE} / 255 * 2 - 1)::FLOAT)::DOUBLE, 4) + 0.0 AS value FROM d")
def save_load_png(spark, sf_dir):
    folder = new_folder(spark, "png")
    rows = images(spark, sf_dir, (3, 8, 8)).withColumn("path", F.concat(F.lit("x/"), F.col("vec_id").cast("string"), F.lit(".PNG")))
    run(rows.withColumn("image", tn.mapped(F.col("image"), lambda v, i: byte(v) / 255)), sinks.SaveImage("image", "path", folder, 0.0, 1.0))
    back = rows.withColumn("path", F.concat(F.lit(f"{folder}/epoch-0/"), F.col("idx").cast("string"), F.lit("-"), F.col("vec_id").cast("string"), F.lit("-image.png"))).drop("image")
    return values(run(back, files.LoadImage("path", "image", -1.0, 1.0, [".png"])))


# ---- videos


@query(
    "load_video",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, floor({u('clip', '0', 'vec_id')} * 5)::BIGINT + 1 AS first FROM embeddings),
    d AS (SELECT vec_id, x, first, unnest(range(0, 72)) AS pos FROM e), p AS (SELECT vec_id, pos, x[(first + pos % 24 // 8) * 8 + pos % 8 + 1] AS v FROM d)
    SELECT vec_id, pos::INTEGER AS pos, {_BYTE} + 0.0 AS value FROM p""",
)
def load_video(spark, sf_dir):
    """The values as eight grey frames of 2 x 4, of which three are taken from a drawn place on."""
    folder = new_folder(spark, "videos")
    rows = images(spark, sf_dir).drop("image").withColumns({"path": F.concat(F.lit(f"{folder}/"), F.col("vec_id").cast("string"), F.lit(".y4m")), "count": F.lit(3)})
    frame = lambda k: F.concat(F.lit("46 52 41 4D 45 0A"), *[F.lpad(F.hex(byte(F.get("embedding", F.lit(8 * k + j)))), 2, "0") for j in range(8)])
    head = F.hex(F.lit("YUV4MPEG2 W4 H2 F24:1 Ip A1:1 Cmono XCOLORRANGE=FULL\n"))
    content = F.unhex(F.replace(F.concat(head, *[frame(k) for k in range(8)]), F.lit(" "), F.lit("")))
    write_files(rows.select("path", content.alias("content")))
    return values(run(rows, files.LoadVideo("path", "count", "image", 0.0, 255.0, 24.0, [".y4m"], salt="clip")))


# ---- special tags in files

_IN_FILES = "list_contains(CASE WHEN doc_id % 2 = 0 THEN ['the', 'of', 'de', 'und'] ELSE ['la', 'a, b', 'der'] END, x)"


@query("drop_tags_files", _drop_sql(tags.RANDOM, tags.WHITELIST, " ", _IN_FILES))
def drop_tags_files(spark, sf_dir):
    """Tags that stay from a text file for every other document, and from a CSV file for those between."""
    folder = new_folder(spark, "tags")
    write_file(f"{folder}/a.txt", b"the\r\nof\nde\nund\n")
    write_file(f"{folder}/b.csv", b'la,1\n"a, b",2\n\nder\n')
    named = F.when(F.col("doc_id") % 2 == 0, f"{folder}/a.txt").otherwise(f"{folder}/b.csv")
    rows = documents(spark, sf_dir, on=True, p=0.4, mode=tags.RANDOM, special=tags.WHITELIST, delimiter=" ", keep=2).withColumn("listed", named)
    stage = tags.DropTags("text", "on", "p", "mode", "special", "delimiter", "keep", "caption", special_tags_in="listed", special_files=[f"{folder}/a.txt", f"{folder}/b.csv"], salt="drop")
    return run(rows, stage).select("doc_id", "caption")


# ---- listing

_TREE = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 4 THEN '.hidden/' WHEN doc_id % 5 = 3 THEN 'a/b/' ELSE 'a/' END AS inner_folder,
    CASE WHEN doc_id % 3 = 0 THEN '.TXT' WHEN doc_id % 7 = 0 THEN '.md' ELSE '.txt' END AS extension, substr(source, 4)::BIGINT AS concept FROM documents WHERE source IS NOT NULL"""


@query(
    "collect_paths",
    f"""WITH f AS ({_TREE}), k AS (SELECT concept, inner_folder || doc_id || extension AS path, doc_id FROM f WHERE lower(extension) = '.txt' AND NOT ends_with(doc_id::VARCHAR, '9')
    AND (inner_folder = '' OR inner_folder <> '.hidden/' AND concept % 2 = 0) AND concept % 4 <> 3)
    SELECT row_number() OVER (ORDER BY concept, 'c' || concept || '/' || path) - 1 AS idx, 'c' || concept || '/' || path AS path, 'c' || concept AS name, 'caption ' || doc_id AS caption FROM k""",
)
def collect_paths(spark, sf_dir):
    """A concept a source, with folders below it for some; a text file a document."""
    folder = new_folder(spark, "files")
    docs = documents(spark, sf_dir).filter("source is not null").withColumn("concept", F.substring("source", 4, 9).cast("long"))
    inner = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 4, ".hidden/").when(F.col("doc_id") % 5 == 3, "a/b/").otherwise("a/")
    extension = F.when(F.col("doc_id") % 3 == 0, ".TXT").when(F.col("doc_id") % 7 == 0, ".md").otherwise(".txt")
    path = F.concat(F.lit(f"{folder}/c"), F.col("concept").cast("string"), F.lit("/"), inner, F.col("doc_id").cast("string"), extension)
    write_files(docs.select(path.alias("path"), F.encode(F.concat(F.lit(" caption "), F.col("doc_id").cast("string"), F.lit("\nmore")), "UTF-8").alias("content")))
    name = F.concat(F.lit("c"), F.col("concept").cast("string"))
    given = docs.select("concept").distinct().select(F.col("concept").alias("idx"), F.struct(name.alias("name"), F.concat(F.lit(f"{folder}/"), name).alias("path"), (F.col("concept") % 2 == 0).alias("below"), (F.col("concept") % 4 != 3).alias("enabled")).alias("concept"))
    stages = [files.CollectPaths("concept", "concept.path", "concept.below", "concept.enabled", "path", "concept", [".txt"], None, ["9"]), files.LoadText("path", "caption")]
    rows = Pipeline(spark, given, {}, stages, 1, seed=SEED).epoch(0)
    return rows.select("idx", F.replace("path", F.lit(f"{folder}/"), F.lit("")).alias("path"), F.col("concept.name").alias("name"), "caption")


# ---- whole pipelines

_SHARDS = "SELECT epoch, i // 3 AS idx, doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), (SELECT unnest([1, 2]) AS epoch) WHERE i % 3 = 1 AND i // 3 < n // 3"


@query(
    "pipeline_epochs",
    f"""WITH s AS ({_SHARDS}), k AS (SELECT *, max(idx) OVER () + 1 AS n FROM s)
    SELECT epoch, idx // 8 AS batch_id, string_agg(doc_id, ',' ORDER BY idx) AS ids, min(source || '-1.txt') AS first_path, '512' AS resolution FROM k WHERE idx // 8 < n // 8 AND (epoch = 2 OR idx >= 16) GROUP BY epoch, idx // 8""",
)
def pipeline_epochs(spark, sf_dir):
    """Documents as concepts through a pipeline of two epochs: a shard of three, batches of eight, the first epoch
    resumed from its twentieth sample on."""
    given = documents(spark, sf_dir).select("doc_id", F.struct("doc_id", "source").alias("concept"))
    numbered = dense_index(given, [F.col("doc_id")]).select("idx", "concept")
    stages = [
        None,
        [paths.ModifyPath("concept.source", "path", "-1", ".txt"), [order.DistributedSampler(["concept", "path", "settings"], 3, 1)]],
        paths.OutputColumns([("concept.doc_id", "doc_id"), "path", ("settings.resolution", "resolution")]),
    ]
    pipeline = Pipeline(spark, numbered, {"resolution": "512"}, stages, 8, seed=SEED, initial_epoch=1, initial_epoch_sample=20)
    out = None
    for epoch in (1, 2):
        batches = pipeline.batches(epoch).select(F.lit(epoch).alias("epoch"), "batch_id", F.array_join(F.transform("doc_id", lambda x: x.cast("string")), ",").alias("ids"), F.array_min("path").alias("first_path"), F.get("resolution", F.lit(0)).alias("resolution"))
        out = batches if out is None else out.union(batches)
    return out


# ---- tokenizers and chat templates


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("subword_round_trip", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def subword_round_trip(spark, sf_dir):
    """Whole texts to byte-level tokens and back."""
    tokenizer = subwords.BytePairTokenizer(public_file("byte_bpe_50k.json"))
    rows = documents(spark, sf_dir).withColumn("tokens", tokenizer.ids(F.coalesce("text", F.lit(""))))
    return run(rows, tokens.DecodeTokens("tokens", "back", tokenizer=tokenizer)).select("doc_id", F.md5("back").alias("text_md5"))


@query("tokenize_subwords")
def tokenize_subwords(spark, sf_dir):
    """The first 77 ids with a begin and an end, as text; held against the library in a test."""
    tokenizer = subwords.BytePairTokenizer(public_file("word_bpe_49k.json"), pad_id=49407, begin_id=49406, end_id=49407)
    out = run(documents(spark, sf_dir), tokens.Tokenize("text", "tokens", "mask", tokenizer, 77))
    text = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ",")
    return out.select("doc_id", text("tokens").alias("tokens"), text("mask").alias("mask"))


CHAT = """{%- for m in messages %}
{%- if loop.first and m.role != 'system' %}<|system|>none
{% endif -%}
<|{{ m.role }}|>{{ m['content'] | trim }}{% if not loop.last %}<|end|>
{% endif %}
{%- endfor %}{% if add_generation_prompt %}<|assistant|>{% endif %}"""


@query(
    "chat_template",
    r"""WITH t AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM conversations),
    c AS (SELECT conv_id, string_agg('<|' || coalesce(role, '') || '|>' || text, '<|end|>' || chr(10) ORDER BY turn) AS body, first(role ORDER BY turn) AS opener, count(*) AS n FROM t GROUP BY conv_id)
    SELECT conv_id, CASE WHEN opener <> 'system' THEN '<|system|>none' || chr(10) ELSE '' END || body || '<|assistant|>' AS text FROM c""",
)
def chat_template(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return turns.select("conv_id", ChatTemplate(CHAT, add_generation_prompt=True)(F.col("messages")).alias("text"))
