"""Registered queries of the stages, each with the DuckDB SQL it is held against (where SQL can say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tensor as tn
from .functions.index import dense_index
from .functions.rng import sql_uniform
from .functions.shared import new_folder
from .operators import aspect, balance, geometry, models, order, paths, pixels, tags, tokens
from .plans.pipeline import collate, from_index, with_batches
from .plans.stage import Context, Stage
from .sources import concepts, files

SEED = 42
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, idx: str) -> DataFrame:
    """A table with coordinates: variation 0, and the key as idx."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumns({"variation": F.lit(0), "idx": F.col(idx).cast("long")})


def run(df: DataFrame, *stages: Stage, variation: int = 0) -> DataFrame:
    ctx, shared = df.sparkSession, {}
    for k, stage in enumerate(stages):
        df = stage.apply(df, Context(ctx, SEED, variation, ordinal=k, meta=shared))
    return df


def u(salt: str, draw: str = "0", idx: str = "doc_id", variation: str = "0") -> str:
    return sql_uniform(SEED, f"'{salt}'", variation, idx, draw)


def documents(spark: SparkSession, sf_dir: str, **constants) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id").withColumns({k: F.lit(v) for k, v in constants.items()})


# ---- sources, paths, projection


@query("concept_source", "SELECT n_nationkey::BIGINT AS idx, n_name AS name, n_nationkey::BIGINT AS id FROM nation")
def concept_source(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("idx"), F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id")).alias("concept"))
    return run(rows, concepts.Concepts(rows), paths.OutputColumns([("concept.name", "name"), ("concept.id", "id")])).drop("variation")


@query("settings_broadcast", "SELECT doc_id AS idx, '512, 768' AS resolution, 64::BIGINT AS quantization FROM documents")
def settings_broadcast(spark, sf_dir):
    return run(documents(spark, sf_dir), concepts.Settings({"resolution": "512, 768", "quantization": 64}), paths.OutputColumns([("settings.resolution", "resolution"), ("settings.quantization", "quantization")])).drop("variation")


_PATH = r"regexp_replace(url, '[?#].*$', '')"
_STEM = r"regexp_replace({x}, '^((?:.*/)?\.*[^/.][^/]*)\.[^./]*$', '\1')"


def page_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id").withColumn("path", F.regexp_replace("url", "[?#].*$", ""))


@query(
    "collect_paths_filter",
    rf"""SELECT row_number() OVER (ORDER BY path, page_id) - 1 AS idx, page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages)
    WHERE NOT contains(string_split(path, '/')[-1], '.') AND NOT ends_with(path, '0') AND NOT ends_with(path, '5')
       OR ends_with(path, '.html') AND NOT ends_with(path, '0.html') AND NOT ends_with(path, '5.html')""",
)
def collect_paths_filter(spark, sf_dir):
    kept = files.wanted_paths(page_paths(spark, sf_dir).drop("idx"), F.col("path"), [".HTML", ""], None, ["0", "5"])
    return dense_index(kept.select("page_id", "path"), [F.col("path"), F.col("page_id")])


@query("modify_path", f"SELECT page_id, {_STEM.format(x=_PATH)} || '-masklabel.png' AS mask_path FROM pages")
def modify_path(spark, sf_dir):
    return run(page_paths(spark, sf_dir), paths.ModifyPath("path", "mask_path", "-masklabel", ".png")).select("page_id", "mask_path")


_NAME = f"string_split({_PATH}, '/')[-1]"


@query("get_filename", f"SELECT page_id, {_NAME} AS full_name, {_STEM.format(x=_NAME)} AS short_name FROM pages")
def get_filename(spark, sf_dir):
    return run(page_paths(spark, sf_dir), paths.GetFilename("path", "full_name", True), paths.GetFilename("path", "short_name", False)).select("page_id", "full_name", "short_name")


_LINES = r"regexp_split_to_array(text, '\r\n|\r|\n')"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query("load_text_first_line", f"SELECT doc_id, coalesce({_STRIP.format(x=_LINES + '[1]')}, '') AS caption FROM documents")
def load_text_first_line(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", files.first_line(F.col("text")).alias("caption"))


@query(
    "load_multiple_texts",
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform({_LINES}, lambda x: {_STRIP.format(x='x')}), lambda x: x <> '') AS lines FROM documents)
    SELECT doc_id, len(CASE WHEN len(lines) = 0 THEN [''] ELSE lines END)::BIGINT AS n_lines, array_to_string(CASE WHEN len(lines) = 0 THEN [''] ELSE lines END, '~') AS joined FROM l""",
)
def load_multiple_texts(spark, sf_dir):
    lines = files.all_lines(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.array_join(lines, "~").alias("joined"))


def labelled(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return documents(spark, sf_dir).join(labels, "doc_id", "left")


@query("select_first", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 0 THEN d.source END, d.lang) AS chosen FROM documents d LEFT JOIN labels l USING (doc_id)")
def select_first(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("clean", F.when(F.col("toxic") == 0, F.col("source")))
    return run(rows, paths.SelectFirstInput(["clean", "lang"], "chosen")).select("doc_id", "chosen")


@query("select_input", "SELECT d.doc_id, CASE WHEN l.toxic = 0 THEN d.source WHEN l.toxic = 1 THEN d.lang ELSE 'none' END AS chosen FROM documents d LEFT JOIN labels l USING (doc_id)")
def select_input(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumns({"fallback": F.lit("none"), "empty": F.lit(None).cast("string")})
    return run(rows, paths.SelectInput("toxic", "chosen", {0: "source", 1: "lang", None: "empty"}, "fallback")).select("doc_id", "chosen")


@query(
    "select_random_text",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, lines[floor({u("pick")} * len(lines))::BIGINT + 1] AS caption FROM l""",
)
def select_random_text(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("lines", F.split("text", "\n"))
    return run(rows, paths.SelectRandomText("lines", "caption", salt="pick")).select("doc_id", "caption")


@query("map_data", "SELECT doc_id, n_chars * 2 + 1 AS doubled FROM documents")
def map_data(spark, sf_dir):
    return run(documents(spark, sf_dir), paths.MapData("n_chars", "doubled", lambda x: x * 2 + 1)).select("doc_id", "doubled")


@query("output_rename", "SELECT 0 AS variation, doc_id AS idx, lang, source AS origin FROM documents")
def output_rename(spark, sf_dir):
    return run(documents(spark, sf_dir), paths.OutputColumns(["lang", ("source", "origin")]))


# ---- tags


@query("replace_text", "SELECT doc_id, replace(text, 'th', '(T)') AS caption FROM documents")
def replace_text(spark, sf_dir):
    return run(documents(spark, sf_dir), tags.ReplaceText("text", "caption", "th", "(T)")).select("doc_id", "caption")


def sql_tags(delimiter: str, rest: str, keep: int = 2) -> str:
    """Tags split as h (the first) and r (the rest), then the given list expression of r."""
    return f"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, '{delimiter}'), lambda x: {_STRIP.format(x="x")}), lambda x: x <> '') AS tags FROM documents),
    k AS (SELECT doc_id, tags[1:{keep}] AS h, tags[{keep + 1}:] AS r FROM t)
    SELECT doc_id, array_to_string(list_concat(h, {rest}), '{delimiter} ') AS caption FROM k"""


@query("shuffle_tags", sql_tags(",", f"list_transform(list_sort(list_transform(r, lambda x, i: {{'u': {u('mix', 'i - 1')}, 'i': i, 't': x}})), lambda x: x.t)", 3))
def shuffle_tags(spark, sf_dir):
    rows = documents(spark, sf_dir, on=True, delimiter=",", keep=3)
    return run(rows, tags.ShuffleTags("text", "on", "delimiter", "keep", "caption", salt="mix")).select("doc_id", "caption")


SPECIAL = ["the", "of", "de", "und"]


def _drop_query(mode: str, special: str, delimiter: str, regex: bool = False, given: list[str] = SPECIAL):
    def drop(spark, sf_dir):
        rows = documents(spark, sf_dir, on=True, p=0.4, mode=mode, special=special, delimiter=delimiter, keep=2)
        stage = tags.DropTags("text", "on", "p", "mode", "special", "delimiter", "keep", "caption", special_tags=given, regex_enabled=regex, salt="drop")
        return run(rows, stage).select("doc_id", "caption")

    return drop


def _drop_sql(mode: str, special: str, delimiter: str, listed: str) -> str:
    spared = {"NONE": "false", "WHITELIST": listed, "BLACKLIST": f"NOT ({listed})"}[special]
    if mode == tags.FULL:
        return sql_tags(delimiter, f"CASE WHEN {u('drop')} < 0.4::DOUBLE THEN list_filter(r, lambda x: {spared}) ELSE r END")
    p = "0.4::DOUBLE * i / len(r)" if mode == tags.RANDOM_WEIGHTED else "0.4::DOUBLE"
    return sql_tags(delimiter, f"list_filter(r, lambda x, i: {u('drop', 'i - 1')} > {p} OR {spared})")


_LISTED = "list_contains(['the', 'of', 'de', 'und'], x)"
for _mode, _short in ((tags.FULL, "full"), (tags.RANDOM, "random"), (tags.RANDOM_WEIGHTED, "weighted")):
    for _special in (tags.NONE, tags.WHITELIST, tags.BLACKLIST):
        query(f"drop_tags_{_short}_{_special.lower()}", _drop_sql(_mode, _special, " ", _LISTED))(_drop_query(_mode, _special, " "))
_MATCHED = r"(x = 'of' OR regexp_full_match(x, 'th.*') OR regexp_full_match(trim(x, '()'), 'th.*'))"
query("drop_tags_regex", _drop_sql(tags.RANDOM, tags.WHITELIST, " ", _MATCHED))(_drop_query(tags.RANDOM, tags.WHITELIST, " ", True, ["of", "th.*"]))


def _upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


_MODES = {
    "capslock": _upper("x"),
    "title": r"array_to_string(list_transform(string_split(regexp_replace(x, '\s+', ' ', 'g'), ' '), lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), ' ')",
    "first": f"{_upper('x[1]')} || lower(x[2:])",
    "random": f"array_to_string(list_transform(list_filter(regexp_split_to_array(x, ''), lambda c: c <> ''), lambda c, k: CASE WHEN {u('caps', "(i - 1) || '.' || (k - 1)")} < 0.5 THEN {_upper('c')} ELSE lower(c) END), '')",
}


def _capitalize_sql(modes: list[str], lower: bool) -> str:
    pick = f"[{', '.join(repr(m) for m in modes)}][floor({u('caps', "(i - 1) || '.m'")} * {len(modes)})::BIGINT + 1]"
    cases = " ".join(f"WHEN {pick} = '{m}' THEN {_MODES[m]}" for m in modes)
    return f"""WITH t AS (SELECT doc_id, list_transform(string_split({"lower(text)" if lower else "text"}, ','), lambda x: {_STRIP.format(x="x")}) AS tags FROM documents)
    SELECT doc_id, array_to_string(list_transform(tags, lambda x, i: CASE WHEN {u('caps', "(i - 1) || '.p'")} < 0.5::DOUBLE THEN CASE {cases} END ELSE x END), ',') AS caption FROM t"""


def _capitalize_query(modes: list[str], lower: bool):
    def capitalize(spark, sf_dir):
        rows = documents(spark, sf_dir, on=True, p=0.5, modes=", ".join(modes), delimiter=",", lower=lower)
        return run(rows, tags.CapitalizeTags("text", "on", "p", "modes", "delimiter", "lower", "caption", salt="caps")).select("doc_id", "caption")

    return capitalize


for _name, _list, _lower in (("capslock", ["capslock"], False), ("title", ["title"], True), ("first", ["first"], False), ("random", ["random"], False), ("mixed", ["capslock", "first", "title"], True)):
    query(f"capitalize_tags_{_name}", _capitalize_sql(_list, _lower))(_capitalize_query(_list, _lower))


# ---- tokens

VOCABULARY = tokens.HashVocabulary(30_000)
_ID = "(('0x' || substr(md5({w}), 1, 8))::BIGINT % 30000 + 2)::INTEGER"
_IDS = rf"list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), lambda w: {_ID.format(w='w')})"


def _list_text(name: str):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), " ").alias(name)


def tokenized(spark, sf_dir, **parameters):
    return run(documents(spark, sf_dir), tokens.Tokenize("text", "tokens", "tokens_mask", VOCABULARY, 77, **parameters))


def _token_sql(ids: str, mask: str) -> str:
    return f"WITH t AS (SELECT doc_id, {_IDS} AS ids FROM documents) SELECT doc_id, array_to_string({ids}, ' ') AS tokens, array_to_string({mask}, ' ') AS tokens_mask FROM t"


_ONES = "list_transform(ids, lambda x: 1)"


@query("tokenize_hash", _token_sql("list_resize(ids, 77, 0)", f"list_resize({_ONES}, 77, 0)"))
def tokenize_hash(spark, sf_dir):
    return tokenized(spark, sf_dir).select("doc_id", _list_text("tokens"), _list_text("tokens_mask"))


@query("tokenize_suffix_expand", _token_sql(f"list_concat(list_resize(ids, 77, 0), [{_ID.format(w=repr('end'))}, {_ID.format(w=repr('now'))}])", f"list_concat(list_resize(list_concat({_ONES}, [1, 1, 1]), 77, 0), [1, 1])"))
def tokenize_suffix_expand(spark, sf_dir):
    return tokenized(spark, sf_dir, suffix_text="End now", expand_mask=3).select("doc_id", _list_text("tokens"), _list_text("tokens_mask"))


@query("prune_tokens", f"WITH t AS (SELECT doc_id, {_IDS} AS ids FROM documents) SELECT doc_id, array_to_string(ids[1:77], ' ') AS tokens, least(len(ids), 77)::BIGINT AS n FROM t")
def prune_tokens(spark, sf_dir):
    out = run(tokenized(spark, sf_dir), tokens.PruneMaskedTokens("tokens", "tokens_mask"))
    return out.select("doc_id", _list_text("tokens"), F.size("tokens_mask").cast("long").alias("n"))


@query("pad_tokens", f"WITH t AS (SELECT doc_id, {_IDS} AS ids FROM documents) SELECT doc_id, array_to_string(list_resize(ids[1:77], 100, 0), ' ') AS tokens, array_to_string(list_resize(list_transform(ids[1:77], lambda x: 1), 100, 0), ' ') AS tokens_mask FROM t")
def pad_tokens(spark, sf_dir):
    out = run(tokenized(spark, sf_dir), tokens.PruneMaskedTokens("tokens", "tokens_mask"), tokens.PadMaskedTokens("tokens", "tokens_mask", None, 100))
    return out.select("doc_id", _list_text("tokens"), _list_text("tokens_mask"))


@query(
    "decode_tokens",
    rf"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[1:77]) AS word,
      unnest(range(1, least(77, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))) + 1)) AS place FROM documents),
    a AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS word FROM documents),
    v AS (SELECT {_ID.format(w="word")} AS id, min(word) AS word FROM a GROUP BY 1),
    d AS (SELECT doc_id, string_agg(v.word, ' ' ORDER BY place) AS decoded FROM w JOIN v ON v.id = {_ID.format(w="w.word")} GROUP BY doc_id)
    SELECT doc_id, coalesce(decoded, '') AS decoded FROM documents LEFT JOIN d USING (doc_id)""",
)
def decode_tokens(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("word")).distinct()
    vocabulary = words.select(VOCABULARY.id_of(F.col("word")).alias("id"), "word")
    return run(tokenized(spark, sf_dir), tokens.DecodeTokens("tokens", "decoded", vocabulary)).select("doc_id", "decoded")


# ---- resolutions

_SIZE = "256 + n_chars % 1024 AS h, 256 + (doc_id * 37) % 1024 AS w"


def sized(spark, sf_dir, **constants):
    h, w = (256 + F.col("n_chars") % 1024).cast("int"), (256 + F.col("doc_id") * 37 % 1024).cast("int")
    return documents(spark, sf_dir, **constants).withColumn("original", F.array(h, w))


def _bucket_rows(targets: list[int], q: int = 64) -> str:
    return ", ".join(f"({t}, {h}, {w})" for t in targets for h, w in aspect.buckets(t, q))


def _scaled(rest: str) -> str:
    return f"""SELECT doc_id, th::BIGINT AS crop_h, tw::BIGINT AS crop_w,
    (CASE WHEN h / w > th / tw THEN round_even(h * (tw / w), 0) ELSE th END)::BIGINT AS scale_h,
    (CASE WHEN h / w > th / tw THEN tw ELSE round_even(w * (th / h), 0) END)::BIGINT AS scale_w {rest}"""


def _sizes(df: DataFrame) -> DataFrame:
    part = lambda c, k, n: F.element_at(c, k).cast("long").alias(n)
    return df.select("doc_id", part("crop", -2, "crop_h"), part("crop", -1, "crop_w"), part("scale", -2, "scale_h"), part("scale", -1, "scale_w"))


def _nearest(targets: list[int], target: str) -> str:
    return f"""WITH b(t, th, tw) AS (VALUES {_bucket_rows(targets)}), d AS (SELECT doc_id, {_SIZE}, {target} AS t FROM documents),
    c AS (SELECT d.*, th, tw, row_number() OVER (PARTITION BY doc_id ORDER BY abs(th / tw - h / w), th, tw) AS rn FROM d JOIN b USING (t)) {_scaled("FROM c WHERE rn = 1")}"""


@query("aspect_bucketing", _nearest([512, 768, 1024], f"[512, 768, 1024][floor({u('aspect')} * 3)::BIGINT + 1]"))
def aspect_bucketing(spark, sf_dir):
    stage = aspect.AspectBucketing(64, "original", "target", "scale", "crop", salt="aspect")
    return _sizes(run(sized(spark, sf_dir, target="512, 768, 1024"), stage))


@query("aspect_fixed", f"WITH d AS (SELECT doc_id, {_SIZE}, 768 AS th, 1024 AS tw FROM documents) {_scaled('FROM d')}")
def aspect_fixed(spark, sf_dir):
    return _sizes(run(sized(spark, sf_dir, target="1000x770"), aspect.AspectBucketing(64, "original", "target", "scale", "crop")))


@query("aspect_override", _nearest([512, 768], "CASE WHEN lang = 'en' THEN 768 ELSE 512 END"))
def aspect_override(spark, sf_dir):
    rows = sized(spark, sf_dir, target="512", other="768").withColumn("override", F.col("lang") == "en")
    return _sizes(run(rows, aspect.AspectBucketing(64, "original", "target", "scale", "crop", "override", "other")))


@query("aspect_meta", f"SELECT DISTINCT f::BIGINT AS frames, th::BIGINT AS height, tw::BIGINT AS width FROM (VALUES {_bucket_rows([512, 768])}) b(t, th, tw), (VALUES (1), (9)) g(f)")
def aspect_meta(spark, sf_dir):
    stage = aspect.AspectBucketing(64, "original", "target", "scale", "crop", target_frames_in="frames", frame_dim_enabled=True)
    found = stage.possible_resolutions(sized(spark, sf_dir, target="512, 768", frames=9))
    return spark.createDataFrame(found, "frames long, height long, width long")


@query("single_aspect", f"WITH d AS (SELECT doc_id, {_SIZE}, [512, 768][floor({u('single')} * 2)::BIGINT + 1] AS th, [512, 768][floor({u('single')} * 2)::BIGINT + 1] AS tw FROM documents) {_scaled('FROM d')}")
def single_aspect(spark, sf_dir):
    return _sizes(run(sized(spark, sf_dir, target="512, 768"), aspect.SingleAspectCalculation("original", "target", "scale", "crop", salt="single")))


# ---- groups, balance, caches


def _balance_sql(count: str, variation: int = 0, where: str = "true", extra: str = "") -> str:
    return f"""WITH df AS (SELECT d.doc_id AS i, d.source AS g FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {where}),
    m AS (SELECT g, min(i) AS f, count(*) AS n, {count} AS k FROM df GROUP BY g),
    o AS (SELECT *, (sum(k) OVER (ORDER BY f) - k)::BIGINT AS off FROM m),
    s AS (SELECT *, unnest(range(0, k)) AS j FROM o),
    e AS (SELECT i, g, row_number() OVER (PARTITION BY g ORDER BY i) - 1 AS gi FROM df)
    SELECT off + j AS idx, i AS doc_id {extra} FROM s JOIN e ON e.g = s.g AND e.gi = (j + {variation} * k) % n"""


def _balanced(spark, sf_dir, strategy: str, balancing: float, variation: int = 0, enabled: str | None = None):
    rows = labelled(spark, sf_dir).withColumns({"balancing": F.lit(balancing), "strategy": F.lit(strategy), "clean": F.col("toxic") == 0})
    stage = balance.VariationSorting(["doc_id"], "balancing", "strategy", ["source"], enabled)
    return run(rows, stage, variation=variation)


@query("group_balance_repeats", _balance_sql("floor(count(*) * 1.5::DOUBLE)::BIGINT"))
def group_balance_repeats(spark, sf_dir):
    return _balanced(spark, sf_dir, balance.REPEATS, 1.5).drop("variation")


@query("group_balance_samples", _balance_sql("7::BIGINT"))
def group_balance_samples(spark, sf_dir):
    return _balanced(spark, sf_dir, balance.SAMPLES, 7.9).drop("variation")


@query("group_enabled", _balance_sql("floor(count(*) * 1.5::DOUBLE)::BIGINT", where="l.toxic = 0"))
def group_enabled(spark, sf_dir):
    return _balanced(spark, sf_dir, balance.REPEATS, 1.5, enabled="clean").drop("variation")


@query("variation_sorting_epochs", " UNION ALL ".join(f"SELECT {v} AS variation, * FROM ({_balance_sql('floor(count(*) * 0.7::DOUBLE)::BIGINT', v)})" for v in range(3)))
def variation_sorting_epochs(spark, sf_dir):
    first, *others = [_balanced(spark, sf_dir, balance.REPEATS, 0.7, v) for v in range(3)]
    for o in others:
        first = first.unionByName(o)
    return first


def _cache_rows(spark, sf_dir):
    return documents(spark, sf_dir, balancing=2.5, strategy=balance.REPEATS, variations=3)


_CACHED = paths.MapData("doc_id", "drawn", lambda x: F.col("variation") * 1_000_000 + x)


@query("ram_cache_expand", _balance_sql("floor(count(*) * 2.5::DOUBLE)::BIGINT", 1, extra=", ((j + k) // n)::INTEGER AS in_variation, ((j + k) // n) * 1000000 + i AS drawn"))
def ram_cache_expand(spark, sf_dir):
    stage = balance.RamCache(["doc_id", "drawn"], "balancing", "strategy", ["source"], make=[_CACHED])
    return run(_cache_rows(spark, sf_dir), stage, variation=1).drop("variation")


@query("disk_cache_variations", _balance_sql("floor(count(*) * 2.5::DOUBLE)::BIGINT", 1, extra=", (((j + k) // n) % 3)::INTEGER AS in_variation, (((j + k) // n) % 3) * 1000000 + i AS drawn"))
def disk_cache_variations(spark, sf_dir):
    stage = balance.DiskCache(new_folder(spark, "cache"), ["drawn"], ["doc_id"], "variations", "balancing", "strategy", ["source"], make=[_CACHED])
    return run(_cache_rows(spark, sf_dir), stage, variation=1).drop("variation")


# ---- order


def events(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id")


def _key(salt: str, draw: str, idx: str) -> str:
    return sql_uniform(SEED, f"'{salt}'", "0", idx, draw)


_SORTED = f"""WITH p AS (SELECT event_id, event_type AS b, row_number() OVER (PARTITION BY event_type ORDER BY {_key("sort", "'row'", "event_id")}, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    q AS (SELECT *, pos // 8 AS bt FROM p WHERE pos < (n // 8) * 8),
    r AS (SELECT b, bt, row_number() OVER (ORDER BY {_key("sort", "'batch|' || b || '|' || bt", "-1")}, b, bt) - 1 AS number FROM (SELECT DISTINCT b, bt FROM q))"""


@query("aspect_batch_sort", f"{_SORTED} SELECT number * 8 + pos % 8 AS idx, event_id FROM q JOIN r USING (b, bt)")
def aspect_batch_sort(spark, sf_dir):
    return run(events(spark, sf_dir), order.AspectBatchSorting("event_type", ["event_id"], 8, salt="sort")).select("idx", "event_id")


_INLINE = f"""WITH a AS (SELECT event_id, event_type AS b, row_number() OVER (ORDER BY {_key("inline", "'row'", "event_id")}, event_id) - 1 AS seq FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY seq) - 1 AS pos FROM a WHERE seq >= 24),
    q AS (SELECT *, pos // 8 AS bt FROM p), r AS (SELECT b, bt, row_number() OVER (ORDER BY max(seq)) - 1 AS number FROM q GROUP BY b, bt HAVING count(*) = 8)
    SELECT number * 8 + pos % 8 AS idx, event_id FROM q JOIN r USING (b, bt)"""


@query("inline_aspect_batch_sort", _INLINE)
def inline_aspect_batch_sort(spark, sf_dir):
    return run(events(spark, sf_dir), order.InlineAspectBatchSorting("event_type", ["event_id"], 8, 24, salt="inline")).select("idx", "event_id")


def ranked_orders(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return dense_index(orders, [F.col("o_orderkey")]).withColumn("variation", F.lit(0))


_RANKED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders"
_SHARD = "SELECT i // 7 AS idx, o_orderkey FROM ({rows}) WHERE i % 7 = 3 AND i // 7 < n // 7"


@query("distributed_sampler", _SHARD.format(rows=_RANKED))
def distributed_sampler(spark, sf_dir):
    return run(ranked_orders(spark, sf_dir), order.DistributedSampler(["o_orderkey"], 7, 3)).drop("variation")


@query("inline_distributed_sampler", f"SELECT i // 4 AS idx, event_id FROM (SELECT idx AS i, event_id, count(*) OVER () AS n FROM ({_INLINE})) WHERE i % 4 = 1 AND i // 4 < n // 4")
def inline_distributed_sampler(spark, sf_dir):
    stages = [order.InlineAspectBatchSorting("event_type", ["event_id"], 8, 24, salt="inline"), order.InlineDistributedSampler(["event_id"], 4, 1)]
    return run(events(spark, sf_dir), *stages).drop("variation")


@query("drop_last_batches", f"SELECT i // 16 AS batch_id, o_orderkey FROM ({_RANKED}) WHERE i < (n // 16) * 16")
def drop_last_batches(spark, sf_dir):
    return with_batches(ranked_orders(spark, sf_dir), 16).select("batch_id", "o_orderkey")


@query("collated_batches", f"SELECT i // 16 AS batch_id, string_agg(o_orderkey, ',' ORDER BY i) AS keys FROM ({_RANKED}) WHERE i < (n // 16) * 16 GROUP BY 1")
def collated_batches(spark, sf_dir):
    rows = collate(with_batches(ranked_orders(spark, sf_dir).drop("o_totalprice"), 16))
    return rows.select("batch_id", F.array_join(F.transform("o_orderkey", lambda x: x.cast("string")), ",").alias("keys"))


@query("resume_index", f"SELECT i AS idx, o_orderkey FROM ({_RANKED}) WHERE i >= 96")
def resume_index(spark, sf_dir):
    return from_index(ranked_orders(spark, sf_dir), 101, 16).select("idx", "o_orderkey")


# ---- tensors: embeddings as 1 x 8 x 8, and as 3 x 8 x 8: the values, these negated, and half of them


def images(spark, sf_dir, shape=(1, 8, 8), **constants) -> DataFrame:
    x = F.col("embedding")
    data = x if shape[0] == 1 else F.concat(x, F.transform(x, lambda v: -v), F.transform(x, lambda v: v / 2))
    rows = table(spark, sf_dir, "embeddings", "vec_id").withColumns({k: F.lit(v) for k, v in constants.items()})
    rows = rows.withColumn("image", tn.tensor(tn.literal_shape(*shape), data))
    return rows.withColumn("mask", tn.tensor(tn.literal_shape(1, *shape[1:]), F.transform(x, lambda v: (v > 0).cast("float"))))


def values(df: DataFrame, name: str = "image") -> DataFrame:
    each = df.select("vec_id", F.posexplode(f"{name}.data").alias("pos", "v"))
    return each.select("vec_id", "pos", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("value"))


_COLOURS = "list_concat(embedding, list_transform(embedding, lambda v: -v), list_transform(embedding, lambda v: v / 2))::DOUBLE[]"


def _values_sql(expression: str, values: str = "embedding::DOUBLE[]") -> str:
    """expression: a list of DOUBLE over x (values: those of the embedding, or _COLOURS)."""
    return f"""WITH e AS (SELECT vec_id, {values} AS x FROM embeddings), d AS (SELECT vec_id, ({expression})::FLOAT[] AS d FROM e)
    SELECT vec_id, unnest(range(0, len(d)))::INTEGER AS pos, round(unnest(d)::DOUBLE, 4) + 0.0 AS value FROM d"""


@query("calc_aspect", "SELECT vec_id, 8::BIGINT AS height, 8::BIGINT AS width FROM embeddings")
def calc_aspect(spark, sf_dir):
    out = run(images(spark, sf_dir), pixels.CalcAspect("image", "resolution"))
    return out.select("vec_id", F.col("resolution")[0].cast("long").alias("height"), F.col("resolution")[1].cast("long").alias("width"))


@query("image_to_video", "SELECT vec_id, '1x1x8x8' AS shape FROM embeddings")
def image_to_video(spark, sf_dir):
    return run(images(spark, sf_dir), pixels.ImageToVideo("image", "video")).select("vec_id", F.array_join(F.transform("video.shape", lambda s: s.cast("string")), "x").alias("shape"))


@query("image_like", _values_sql("list_concat(list_transform(range(0, 64), lambda i: 51 / 255.0::DOUBLE * 2 - 1), list_transform(range(0, 64), lambda i: 255 / 255.0::DOUBLE * 2 - 1))"))
def image_like(spark, sf_dir):
    return values(run(images(spark, sf_dir), pixels.GenerateImageLike("image", "blank", (51, 255), -1.0, 1.0)), "blank")


@query("rescale_channels", _values_sql("list_transform(x, lambda v: (v + 1) * (255.0::DOUBLE / 2) + 0)"))
def rescale_channels(spark, sf_dir):
    return values(run(images(spark, sf_dir), pixels.RescaleImageChannels("image", "out", -1.0, 1.0, 0.0, 255.0)), "out")


@query("normalize_channels", _values_sql("list_transform(x, lambda v, i: (v - [0.5::DOUBLE, 0.4::DOUBLE, 0.3::DOUBLE][(i - 1) // 64 + 1]) / [0.2::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE][(i - 1) // 64 + 1])", _COLOURS))
def normalize_channels(spark, sf_dir):
    return values(run(images(spark, sf_dir, (3, 8, 8)), pixels.NormalizeImageChannels("image", "out", [0.5, 0.4, 0.3], [0.2, 0.25, 0.5])), "out")


@query("masked_conditioning", _values_sql("list_transform(x, lambda v, i: CASE WHEN x[(i - 1) % 64 + 1] > 0 THEN 0.75::DOUBLE ELSE v END)", _COLOURS))
def masked_conditioning(spark, sf_dir):
    return values(run(images(spark, sf_dir, (3, 8, 8)), pixels.GenerateMaskedConditioningImage("image", "mask", "out", -0.5, 1.0)), "out")


@query("random_flip", _values_sql(f"CASE WHEN {u('flip', '0', 'vec_id')} < 0.5 THEN list_transform(range(0, 64), lambda i: x[(i // 8) * 8 + 7 - i % 8 + 1]) ELSE x END"))
def random_flip(spark, sf_dir):
    return values(run(images(spark, sf_dir, on=True, fixed=False), pixels.RandomFlip(["image"], "on", "fixed", salt="flip")))


@query("crop_center", _values_sql("list_transform(range(0, 24), lambda k: x[(2 + k // 6) * 8 + 1 + k % 6 + 1])"))
def crop_center(spark, sf_dir):
    rows = images(spark, sf_dir).withColumn("size", F.array(F.lit(4), F.lit(6)))
    return values(run(rows, pixels.CropImage(["image"], "size")))


@query("crop_jitter", _values_sql(f"list_transform(range(0, 24), lambda k: x[(floor({u('crop', '0', 'vec_id')} * 5)::BIGINT + k // 6) * 8 + floor({u('crop', '1', 'vec_id')} * 3)::BIGINT + k % 6 + 1])"))
def crop_jitter(spark, sf_dir):
    rows = images(spark, sf_dir, jitter=True).withColumn("size", F.array(F.lit(4), F.lit(6)))
    return values(run(rows, pixels.CropImage(["image"], "size", "jitter", salt="crop")))


def _strength(salt: str) -> str:
    return f"greatest(0.0::DOUBLE, 1 - 0.3::DOUBLE + {u(salt, '0', 'vec_id')} * 2 * 0.3::DOUBLE)"


_CLAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


@query("random_brightness", _values_sql(f"list_transform(x, lambda v: {_CLAMP.format(x=f'v * {_strength("bright")}')})"))
def random_brightness(spark, sf_dir):
    return values(run(images(spark, sf_dir, on=True, fixed=False, s=0.3), pixels.RandomBrightness(["image"], "on", "fixed", "s", salt="bright")))


_GREY = "list_transform(range(1, 65), lambda k: x[k] * 0.2989::DOUBLE + x[k + 64] * 0.587::DOUBLE + x[k + 128] * 0.114::DOUBLE)"


@query("random_contrast", _values_sql(f"list_transform(x, lambda v: {_CLAMP.format(x=f'v * {_strength("contrast")} + list_sum({_GREY}) / 64 * (1 - {_strength("contrast")})')})", _COLOURS))
def random_contrast(spark, sf_dir):
    return values(run(images(spark, sf_dir, (3, 8, 8), on=True, fixed=False, s=0.3), pixels.RandomContrast(["image"], "on", "fixed", "s", salt="contrast")))


@query("random_saturation", _values_sql(f"list_transform(x, lambda v, i: {_CLAMP.format(x=f'v * {_strength("sat")} + ({_GREY})[(i - 1) % 64 + 1] * (1 - {_strength("sat")})')})", _COLOURS))
def random_saturation(spark, sf_dir):
    return values(run(images(spark, sf_dir, (3, 8, 8), on=True, fixed=False, s=0.3), pixels.RandomSaturation(["image"], "on", "fixed", "s", salt="sat")))


@query(
    "circular_mask_shrink",
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m FROM embeddings),
    c AS (SELECT vec_id, m, -(list_sort(list_transform(m, lambda v, i: {{'u': {u("disc", "'p' || (i - 1)", "vec_id")} * v, 'i': 1 - i}}))[-1].i) AS c FROM e),
    a AS (SELECT vec_id, m, list_transform(range(0, 64), lambda i: sqrt((i // 8 - c // 8) * (i // 8 - c // 8) + (i % 8 - c % 8) * (i % 8 - c % 8))) AS away FROM c),
    d AS (SELECT vec_id, list_transform(m, lambda v, i: CASE WHEN away[i] <= list_max(list_transform(m, lambda y, k: y * away[k])) * (0.4::DOUBLE + {u("disc", "'f'", "vec_id")} * 0.6::DOUBLE) THEN v ELSE 0 END) AS d FROM a)
    SELECT vec_id, unnest(range(0, 64))::INTEGER AS pos, unnest(d)::DOUBLE + 0.0 AS value FROM d""",
)
def circular_mask_shrink(spark, sf_dir):
    stage = pixels.RandomCircularMaskShrink("mask", "on", 1.0, 0.4, 1.0, salt="disc")
    return values(run(images(spark, sf_dir, on=True), stage), "mask")


@query(
    "mask_bounding_box",
    """WITH h AS (SELECT vec_id, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0) AS hits FROM embeddings)
    SELECT vec_id, coalesce(list_min(list_transform(hits, lambda i: i // 8)), 0)::BIGINT AS y_min, coalesce(list_max(list_transform(hits, lambda i: i // 8)), 8)::BIGINT AS y_max,
    coalesce(list_min(list_transform(hits, lambda i: i % 8)), 0)::BIGINT AS x_min, coalesce(list_max(list_transform(hits, lambda i: i % 8)), 8)::BIGINT AS x_max FROM h""",
)
def mask_bounding_box(spark, sf_dir):
    box = images(spark, sf_dir).select("vec_id", pixels.bounding_box(F.col("mask")).alias("b"))
    return box.select("vec_id", *[F.col(f"b.{k}").cast("long").alias(k) for k in ("y_min", "y_max", "x_min", "x_max")])


@query("latent_mask_remove", _values_sql(f"CASE WHEN {u('blank', '0', 'vec_id')} < 0.4::DOUBLE THEN list_transform(x, lambda v: 0.25::DOUBLE) ELSE x END"))
def latent_mask_remove(spark, sf_dir):
    stage = pixels.RandomLatentMaskRemove("mask", "image", 0.4, {(1, 8, 8): [0.25] * 64}, salt="blank")
    return values(run(images(spark, sf_dir), stage))


def _weights_sql(name: str, n: int, m: int) -> str:
    """A table (o, i, w) of the weights with which n samples make m."""
    raw = f"greatest(0.0::DOUBLE, 1 - abs((i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {n / m!r}::DOUBLE) / {max(1.0, n / m)!r}::DOUBLE))"
    return f"{name} AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {raw} AS w FROM range(0, {m}) a(o), range(0, {n}) b(i)))"


def _resized_sql(h: int, w: int, top: int = 0, left: int = 0, rows: int | None = None, columns: int | None = None) -> str:
    """8 x 8 resized to h x w, then rows x columns from (top, left)."""
    rows, columns = rows or h, columns or w
    return f"""WITH {_weights_sql("wy", 8, h)}, {_weights_sql("wx", 8, w)},
    e AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding[1:64])::DOUBLE AS v FROM embeddings),
    s AS (SELECT vec_id, wy.o - {top} AS y, wx.o - {left} AS x, sum(wy.w * v * wx.w)::FLOAT::DOUBLE AS v FROM e JOIN wy ON wy.i = p // 8 JOIN wx ON wx.i = p % 8 GROUP BY ALL)
    SELECT vec_id, (y * {columns} + x)::INTEGER AS pos, round(v, 4) + 0.0 AS value FROM s WHERE y BETWEEN 0 AND {rows - 1} AND x BETWEEN 0 AND {columns - 1}"""


@query("scale_image", _resized_sql(4, 4))
def scale_image(spark, sf_dir):
    return values(run(images(spark, sf_dir), geometry.ScaleImage("image", "out", 0.5)), "out")


@query("scale_crop_image", _resized_sql(12, 10, 2, 1, 8, 8))
def scale_crop_image(spark, sf_dir):
    rows = images(spark, sf_dir).withColumns({"scale": F.array(F.lit(12), F.lit(10)), "size": F.array(F.lit(8), F.lit(8))})
    return values(run(rows, geometry.ScaleCropImage(["image"], "scale", "size")))


_TURN = f"radians({u('turn', '0', 'vec_id')} * 2 * 20.0::DOUBLE - 20.0::DOUBLE)"
_TAP = "CASE WHEN y0 + {dy} BETWEEN 0 AND 7 AND x0 + {dx} BETWEEN 0 AND 7 THEN {wy} * {wx} * a[(y0 + {dy}) * 8 + x0 + {dx} + 1] ELSE 0 END"
_TAPS = " + ".join(_TAP.format(dy=dy, dx=dx, wy=wy, wx=wx) for dy, wy in ((0, "(1 - (sy - y0))"), (1, "(sy - y0)")) for dx, wx in ((0, "(1 - (sx - x0))"), (1, "(sx - x0)")))


@query(
    "random_rotate",
    f"""WITH r AS (SELECT vec_id, embedding[1:64]::DOUBLE[] AS a, {_TURN} AS t FROM embeddings),
    g AS (SELECT vec_id, a, p, 3.5::DOUBLE + cos(t) * (p // 8 - 3.5::DOUBLE) + sin(t) * (p % 8 - 3.5::DOUBLE) AS sy, 3.5::DOUBLE - sin(t) * (p // 8 - 3.5::DOUBLE) + cos(t) * (p % 8 - 3.5::DOUBLE) AS sx FROM r, range(0, 64) q(p)),
    f AS (SELECT *, floor(sy)::BIGINT AS y0, floor(sx)::BIGINT AS x0 FROM g)
    SELECT vec_id, p::INTEGER AS pos, round(({_TAPS})::FLOAT::DOUBLE, 4) + 0.0 AS value FROM f""",
)
def random_rotate(spark, sf_dir):
    return values(run(images(spark, sf_dir, on=True, fixed=False, a=20.0), geometry.RandomRotate(["image"], "on", "fixed", "a", salt="turn")))


_HUE = f"greatest(-0.5::DOUBLE, least(0.5::DOUBLE, ({u('hue', '0', 'vec_id')} - 0.5::DOUBLE) * 0.4::DOUBLE))"


@query(
    "random_hue",
    f"""WITH e AS (SELECT vec_id, {_COLOURS} AS x, {_HUE} AS shift FROM embeddings),
    c AS (SELECT vec_id, shift, p, x[p + 1] AS r, x[p + 65] AS g, x[p + 129] AS b FROM e, range(0, 64) q(p)),
    m AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM c),
    s AS (SELECT *, CASE WHEN top > low THEN top - low ELSE 1 END AS span FROM m),
    h AS (SELECT *, CASE WHEN top = low THEN 0 WHEN top = r THEN (g - b) / span / 6 WHEN top = g THEN (2 + (b - r) / span) / 6 ELSE (4 + (r - g) / span) / 6 END AS hue, CASE WHEN top > 0 THEN (top - low) / top ELSE 0 END AS sat FROM s),
    k AS (SELECT *, (5 - 2 * n) + 6 * (hue - floor(hue) + shift) AS y FROM h, range(0, 3) t(n)),
    w AS (SELECT *, y - 6 * floor(y / 6) AS z FROM k)
    SELECT vec_id, (n * 64 + p)::INTEGER AS pos, round((top - top * sat * greatest(0.0::DOUBLE, least(1.0::DOUBLE, z, 4 - z)))::FLOAT::DOUBLE, 4) + 0.0 AS value FROM w""",
)
def random_hue(spark, sf_dir):
    return values(run(images(spark, sf_dir, (3, 8, 8), on=True, fixed=False, s=0.4), geometry.RandomHue(["image"], "on", "fixed", "s", salt="hue")))


@query("mask_rotate_crop")
def mask_rotate_crop(spark, sf_dir):
    stage = geometry.RandomMaskRotateCrop("mask", ["image"], "on", 4, 10, 30, 20, salt="window")
    return values(run(images(spark, sf_dir, on=True), stage))


def _side(name: str, draws: tuple[int, int]) -> str:
    """low and high of one side of the mask's box with drawn padding of 10 to 30 percent."""
    grown = lambda p: f"(({name}1 - {name}0) / (1 - {p} / 100.0::DOUBLE) - ({name}1 - {name}0))"
    pad = lambda d: f"({grown(10)} + ({grown(30)} - {grown(10)}) * {u('crop', str(d), 'vec_id')}) / 2"
    return f"{name}0 - {pad(draws[0])} AS {name}l, {name}1 + {pad(draws[1])} AS {name}h"


def _inside(name: str) -> str:
    low = f"(CASE WHEN {name}l < 0 THEN 0 ELSE {name}l END)"
    high = f"(CASE WHEN {name}l < 0 THEN {name}h - {name}l ELSE {name}h END)"
    return f"floor(greatest(0, CASE WHEN {high} > 8 THEN {low} + 8 - {high} ELSE {low} END))::BIGINT AS {name}a, floor(least(8, {high}))::BIGINT AS {name}b"


@query(
    "mask_crop",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, x, list_filter(range(0, 64), lambda k: x[k + 1] > 0) AS hits FROM e),
    b AS (SELECT vec_id, x, coalesce(list_min(list_transform(hits, lambda k: k // 8)), 0)::DOUBLE AS y0, coalesce(list_max(list_transform(hits, lambda k: k // 8)), 8)::DOUBLE AS y1,
      coalesce(list_min(list_transform(hits, lambda k: k % 8)), 0)::DOUBLE AS x0, coalesce(list_max(list_transform(hits, lambda k: k % 8)), 8)::DOUBLE AS x1 FROM m),
    p AS (SELECT vec_id, x, {_side("y", (1, 2))}, {_side("x", (3, 4))} FROM b), a AS (SELECT *, (yh - yl) * (xh - xl) AS area FROM p),
    g AS (SELECT *, CASE WHEN area > 0 AND area < 36 THEN sqrt(36 / area) - 1 ELSE 0 END AS more FROM a),
    w AS (SELECT vec_id, x, yl - more * (yh - yl) AS yl, yh + more * (yh - yl) AS yh, xl - more * (xh - xl) AS xl, xh + more * (xh - xl) AS xh FROM g),
    i AS (SELECT vec_id, x, {_inside("y")}, {_inside("x")} FROM w), k AS (SELECT *, unnest(range(0, (yb - ya) * (xb - xa))) AS pos FROM i)
    SELECT vec_id, pos::INTEGER AS pos, round(x[(ya + pos // (xb - xa)) * 8 + xa + pos % (xb - xa) + 1], 4) + 0.0 AS value FROM k""",
)
def mask_crop(spark, sf_dir):
    """The crop around a mask without rotation, at least 6 x 6 in area."""
    return values(run(images(spark, sf_dir, on=True), geometry.RandomMaskRotateCrop("mask", ["image"], "on", 6, 10, 30, 0, salt="crop")))


# ---- model-backed columns, with a port that needs no model


def distributions(spark, sf_dir):
    half = lambda k: tn.tensor(tn.literal_shape(2, 4, 4), F.slice("embedding", k, 32))
    return images(spark, sf_dir).withColumn("distribution", F.struct(half(1).alias("mean"), half(33).alias("logvar")))


@query("vae_mean", _values_sql("x[1:32]"))
def vae_mean(spark, sf_dir):
    return values(run(distributions(spark, sf_dir), models.SampleVAEDistribution("distribution", "latent")), "latent")


@query(
    "vae_sample",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    d AS (SELECT vec_id, list_transform(range(1, 33), lambda i: x[i] + exp(x[i + 32] * 0.5::DOUBLE) * sqrt(-2 * ln(1 - {u("z", "(i - 1) || '.a'", "vec_id")})) * cos(2 * pi() * {u("z", "(i - 1) || '.b'", "vec_id")}))::FLOAT[] AS d FROM e)
    SELECT vec_id, unnest(range(0, 32))::INTEGER AS pos, round(unnest(d)::DOUBLE, 4) + 0.0 AS value FROM d""",
)
def vae_sample(spark, sf_dir):
    return values(run(distributions(spark, sf_dir), models.SampleVAEDistribution("distribution", "latent", "sample", salt="z")), "latent")


@query("vae_encode_decode", _values_sql("list_transform(x, lambda v: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (v * 2)::FLOAT::DOUBLE * 2)))", "embedding[1:32]::DOUBLE[]"))
def vae_encode_decode(spark, sf_dir):
    rows = images(spark, sf_dir).withColumn("image", tn.tensor(tn.literal_shape(2, 8, 4), F.col("embedding")))  # mean and deviation
    port = models.HashPort(factor=2.0)
    return values(run(rows, models.EncodeVAE("image", "d", port), models.SampleVAEDistribution("d", "latent"), models.DecodeVAE("latent", "out", port)), "out")


@query("movq_encode_decode", _values_sql("list_transform(x, lambda v: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (v * 2)::FLOAT::DOUBLE * 2)))"))
def movq_encode_decode(spark, sf_dir):
    port = models.HashPort(factor=2.0)
    return values(run(images(spark, sf_dir), models.EncodeMoVQ("image", "latent", port), models.DecodeMoVQ("latent", "out", port)), "out")


@query("depth_own_range", _values_sql("list_transform(x, lambda v: 2 * (v - list_min(x)) / (list_max(x) - list_min(x)) - 1)"))
def depth_own_range(spark, sf_dir):
    return values(run(images(spark, sf_dir), models.GenerateDepth("image", "depth", models.HashPort())), "depth")


def layered(spark, sf_dir):
    """4 layers of 4 tokens of 4 dimensions."""
    part = lambda start, n: F.slice("embedding", start + 1, n)
    layers = F.array(*[F.array(*[part(16 * a + 4 * t, 4) for t in range(4)]) for a in range(4)])
    mask = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return table(spark, sf_dir, "embeddings", "vec_id").withColumns({"layers": layers, "mask": mask})


def _flat(states) -> DataFrame:
    return F.struct(F.flatten(states).alias("data"))


@query("layer_concat", _values_sql("list_transform(range(0, 32), lambda k: x[[16, 48][(k % 8) // 4 + 1] + (k // 8) * 4 + k % 4 + 1])"))
def layer_concat(spark, sf_dir):
    return values(layered(spark, sf_dir).withColumn("image", _flat(models.layers_joined(F.col("layers"), [1, 3]))))


@query("layer_interleave", _values_sql("list_transform(range(0, 32), lambda k: x[[16, 48][k % 2 + 1] + (k // 8) * 4 + (k % 8) // 2 + 1])"))
def layer_interleave(spark, sf_dir):
    return values(layered(spark, sf_dir).withColumn("image", _flat(models.layers_interleaved(F.col("layers"), [1, 3]))))


@query("layer_norm_states", _values_sql("list_transform(x, lambda v, i: (v - list_avg(x[(i - 1) // 4 * 4 + 1:(i - 1) // 4 * 4 + 4])) / sqrt(list_var_pop(x[(i - 1) // 4 * 4 + 1:(i - 1) // 4 * 4 + 4]) + 0.00001::DOUBLE))"))
def layer_norm_states(spark, sf_dir):
    return values(layered(spark, sf_dir).withColumn("image", _flat(models.normalized(F.flatten("layers")))))


@query("cumsum_positions", "SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda i: greatest(list_sum(list_transform(embedding[1:i], lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END)) - 1, 0)::BIGINT), ' ') AS positions FROM embeddings")
def cumsum_positions(spark, sf_dir):
    positions = F.transform(models.cumulative_positions(F.col("mask")), lambda x: x.cast("string"))
    return layered(spark, sf_dir).select("vec_id", F.array_join(positions, " ").alias("positions"))


@query("crop_start_mask", _values_sql("list_transform(range(0, 60), lambda k: CASE WHEN x[k // 4 + 2] > 0 THEN x[k + 5] ELSE 0 END)"))
def crop_start_mask(spark, sf_dir):
    """The layers' 16 states one after the other, with the first 16 values' signs as their mask."""
    states = models.masked(models.cropped(F.flatten("layers"), 1), models.cropped(F.slice("mask", 1, 16), 1))
    return values(layered(spark, sf_dir).withColumn("image", _flat(states)))


def _state_total(state: str):
    return F.round(F.aggregate(state, F.lit(0.0), lambda t, x: t + x), 3).alias("total")


def _encoder_query(kind, **parameters):
    def encode(spark, sf_dir):
        out = run(tokenized(spark, sf_dir), kind("tokens", "tokens_mask", "state", models.HashPort(), **parameters))
        return out.select("doc_id", F.size("state").cast("long").alias("n"), _state_total(F.flatten("state") if kind is not models.EncodeLlamaText else F.flatten(F.flatten("state"))))

    return encode


def _dimension(layer: int, d: int, token: str = "t") -> str:
    """The port's state of a token: layer and dimension, as the single float it is."""
    return f"sin(({token} + 1)::DOUBLE * {4 * layer + d + 1})::FLOAT::DOUBLE"


def _encoder_sql(n: int, token: str, first: int = 1) -> str:
    """n states; the sum of `token` (an expression of t, the id, and i, its place from 1) over the places from first on."""
    return f"""WITH w AS (SELECT doc_id, {_IDS} AS ids FROM documents), t AS (SELECT doc_id, least(len(ids), 77) AS m, list_resize(ids, 77, 0) AS ids FROM w)
    SELECT doc_id, {n}::BIGINT AS n, round(list_sum(list_transform(list_zip(ids[{first}:], range({first}, 78)), lambda z: {token.replace("<t>", "z[1]").replace("<i>", "z[2]")})), 3) + 0.0 AS total FROM t"""


def _layers_sum(*layers: int) -> str:
    return "(" + " + ".join(_dimension(a, d, "<t>") for a in layers for d in range(4)) + ")"


def _normed(layer: int) -> str:
    x = [_dimension(layer, d, "<t>") for d in range(4)]
    mean = f"(({' + '.join(x)}) / 4)"
    variance = f"(({' + '.join(f'({v} - {mean}) * ({v} - {mean})' for v in x)}) / 4)"
    return "(" + " + ".join(f"(({v} - {mean}) / sqrt({variance} + 0.00001::DOUBLE))::FLOAT::DOUBLE" for v in x) + ")"


query("encode_clip_text", _encoder_sql(77, _normed(2)))(_encoder_query(models.EncodeClipText, hidden_state_output_index=-2, add_layer_norm=True, pooled_out="pooled"))
query("encode_t5_text", _encoder_sql(77, _normed(2)))(_encoder_query(models.EncodeT5Text, hidden_state_output_index=-2, add_layer_norm=True))
query("encode_gemma_text", _encoder_sql(77, _layers_sum(3)))(_encoder_query(models.EncodeGemmaText, hidden_state_output_index=-1))
query("encode_llama_text", _encoder_sql(3, _layers_sum(1, 2, 3), 2))(_encoder_query(models.EncodeLlamaText, output_all_hidden_states=True, all_hidden_state_output_indices=[0, 2], crop_start=1, tokens_mask_out="tokens_mask"))
query("encode_mistral_text", _encoder_sql(77, _layers_sum(1, 3)))(_encoder_query(models.EncodeMistralText, hidden_state_output_index=[1, 3]))
query("encode_qwen_text", _encoder_sql(75, f"CASE WHEN <i> <= m THEN {_layers_sum(1, 3)} ELSE 0 END", 3))(_encoder_query(models.EncodeQwenText, hidden_state_output_index=[1, 3], crop_start=2, cumsum_position_ids=True, position_ids_out="positions"))
query("encode_ideogram_text", _encoder_sql(77, _layers_sum(1, 3)))(_encoder_query(models.EncodeIdeogramText, hidden_state_output_index=[1, 3]))


_CONDITIONED = " + ".join(f"((CASE WHEN <i> <= m THEN {_dimension(3, d, '<t>')} ELSE 0 END * 0.5::DOUBLE + CASE WHEN <i> <= m THEN {_dimension(0, d, '<t>')} ELSE 0 END)::FLOAT::DOUBLE)" for d in range(4))


@query("encode_anima_text", _encoder_sql(77, f"({_CONDITIONED})"))
def encode_anima_text(spark, sf_dir):
    stage = models.EncodeAnimaText("tokens", "tokens_mask", "tokens", "tokens_mask", "state", models.HashPort(), models.HashConditioner())
    return run(tokenized(spark, sf_dir), stage).select("doc_id", F.size("state").cast("long").alias("n"), _state_total(F.flatten("state")))


# ---- a whole epoch


_EPOCH = f"""WITH epoch AS (SELECT idx AS i, doc_id FROM ({_balance_sql('floor(count(*) * 1.5::DOUBLE)::BIGINT')})),
    p AS (SELECT i, d.doc_id, {_SIZE}, coalesce({_STRIP.format(x=_LINES + '[1]')}, '') AS line FROM epoch JOIN documents d USING (doc_id)),
    g AS (SELECT *, list_filter(list_transform(string_split(line, ','), lambda x: {_STRIP.format(x="x")}), lambda x: x <> '') AS tags FROM p),
    f AS (SELECT *, array_to_string(list_concat(tags[1:1], list_transform(list_sort(list_transform(tags[2:], lambda x, k: {{'u': {u('2', 'k - 1', 'i')}, 'k': k, 't': x}})), lambda x: x.t)), ', ') AS mixed FROM g),
    o AS (SELECT *, list_filter(list_transform(string_split(mixed, ','), lambda x: {_STRIP.format(x="x")}), lambda x: x <> '') AS left_tags FROM f),
    n AS (SELECT *, array_to_string(list_concat(left_tags[1:1], list_filter(left_tags[2:], lambda x, k: {u('3', 'k - 1', 'i')} > 0.2::DOUBLE)), ', ') AS prompt, [512, 768][floor({u('4', '0', 'i')} * 2)::BIGINT + 1] AS t FROM o),
    b(t, th, tw) AS (VALUES {_bucket_rows([512, 768])}),
    c AS (SELECT n.*, th, tw, row_number() OVER (PARTITION BY i ORDER BY abs(th / tw - h / w), th, tw) AS rn FROM n JOIN b USING (t)),
    k AS (SELECT *, row_number() OVER (PARTITION BY th, tw ORDER BY {u('6', "'row'", 'i')}, i) - 1 AS pos, count(*) OVER (PARTITION BY th, tw) AS size FROM c WHERE rn = 1),
    q AS (SELECT *, pos // 4 AS bt FROM k WHERE pos < (size // 4) * 4),
    r AS (SELECT th, tw, bt, row_number() OVER (ORDER BY {u('6', "'batch|[' || th || ', ' || tw || ']|' || bt", '-1')}, th, tw, bt) - 1 AS number FROM (SELECT DISTINCT th, tw, bt FROM q))
    SELECT number * 4 + pos % 4 AS idx, number AS batch_id, doc_id, prompt, th || 'x' || tw AS crop, 32::BIGINT AS n_tokens FROM q JOIN r USING (th, tw, bt)"""


@query("caption_epoch", _EPOCH)
def caption_epoch(spark, sf_dir):
    """Captions of labelled documents: first line, tags shuffled and dropped, bucketed, balanced by source,
    and put in whole batches of one resolution."""
    rows = sized(spark, sf_dir, target="512, 768", on=True, delimiter=",", keep=1, p=0.2, mode=tags.RANDOM, special=tags.NONE, balancing=1.5, strategy=balance.REPEATS)
    stages = [
        balance.VariationSorting(["doc_id", "text", "original", "target", "on", "delimiter", "keep", "p", "mode", "special"], "balancing", "strategy", ["source"]),
        paths.MapData("text", "prompt", files.first_line),
        tags.ShuffleTags("prompt", "on", "delimiter", "keep", "prompt"),
        tags.DropTags("prompt", "on", "p", "mode", "special", "delimiter", "keep", "prompt"),
        aspect.AspectBucketing(64, "original", "target", "scale", "crop"),
        tokens.Tokenize("prompt", "tokens", "tokens_mask", VOCABULARY, 32),
        order.AspectBatchSorting("crop", ["doc_id", "prompt", "crop", "tokens"], 4),
        paths.OutputColumns(["doc_id", "prompt", "crop", "tokens"]),
    ]
    return with_batches(run(rows, *stages), 4).select("idx", "batch_id", "doc_id", "prompt", F.concat_ws("x", F.transform("crop", lambda x: x.cast("string"))).alias("crop"), F.size("tokens").cast("long").alias("n_tokens"))


from . import file_queries  # noqa: E402, F401  registers its queries
