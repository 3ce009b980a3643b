"""Main text of web pages by wrapper induction: what same-host pages share is template, what varies is content.

Pages become trees of blocks, trees become shapes in which like neighbours are folded (html_tree). The
distinct shapes of a host are few; they are merged by simple tree matching, FAN of them in a task, level by
level, into one tree: the host's wrapper. Each shape is matched with its wrapper, so that a block stands in
a slot of it. A text that fills one slot on most of a host's distinct pages is template and goes; what
varies in a slot is content, if the elements around it aren't menus, notices and the like. Where pages have no
article element, the content is the part of the wrapper with most of the varying text.

Pages are parsed twice, so that no text is shuffled: once for shapes and hashes of blocks, once with the
host's wrapper at hand, which is broadcast while all wrappers together are small and joined by host otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written
from .html_tree import Block, Node, aligned, lines_of, merge, numbered, read_page, read_shape, shape_of, wanted_blocks, written_shape

#: Shapes that a task merges, and nodes of a wrapper beyond which those on fewer than a hundredth of its pages go.
FAN, WRAPPER_NODES = 64, 2000
#: A text is template on at least so large a part of a host's distinct pages, and on so many of them.
TEMPLATE_PERCENT, TEMPLATE_PAGES = 60, 5
#: Where more of all candidate text would be template, the pages are copies of one with edits, and none of it is:
#: on hosts whose pages have articles, and on others, whose menus and footers are candidates too.
COPIED_PERCENT, COPIED_PERCENT_WITHOUT_ARTICLE = 50, 90
#: The content of a host without article elements: down from the root while a child has so much of the varying text.
CONTENT_PERCENT = 80
#: There, a block with more of its text in links is none.
LINK_PERCENT = 50
#: Pages that a worker holds trees and texts of before it passes them on.
STEP_PAGES = 256
#: Bytes of all wrappers up to which they are broadcast.
BROADCAST_BYTES = 1 << 25

PARSED = "host string, page_hash long, shape string, article boolean, nodes array<int>, hashes array<long>, chars array<int>, links array<int>"


def host_of(url: Column) -> Column:
    """The host in lower case without its port; empty for a null or other text."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def text_hash(text: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def steps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_PAGES):
            yield batch.slice(at, STEP_PAGES)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """A row a page: host, a hash of its candidate texts, its shape, and of each candidate block its node in the
    shape, a hash, its characters and those in links."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.string()), ("page_hash", pa.int64()), ("shape", pa.string()), ("article", pa.bool_()), ("nodes", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("chars", pa.list_(pa.int32())), ("links", pa.list_(pa.int32()))])
        for batch in steps_of(batches):
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root, blocks = read_page(page.as_py() or "")
                shape, made = shape_of(root)
                place = {id(s): k for k, s in enumerate(shape.nodes())}
                wanted, article = wanted_blocks(blocks)
                own = [blocks[k] for k in wanted]
                hashes = [text_hash(b.text) for b in own]
                nodes = [place[id(made[id(b.node)].found())] for b in own]
                rows.append((host, text_hash("\n".join(b.text for b in own)), written_shape(shape), article, nodes, hashes, [len(b.text) for b in own], [min(b.linked, len(b.text)) for b in own]))
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return pages.mapInArrow(parse, PARSED)


def merged_shapes(frame: pd.DataFrame) -> pd.DataFrame:
    """The shapes of one host and block as one, most frequent first."""
    frame = frame.sort_values(["pages", "shape"], ascending=[False, True])
    whole = None
    for text, pages in zip(frame["shape"], frame["pages"], strict=True):
        shape = read_shape(text, int(pages))
        if whole is None:
            whole = shape
        elif whole.label == shape.label:
            merge(whole, shape)
        nodes = list(whole.nodes())
        if len(nodes) > WRAPPER_NODES:
            for node in nodes:
                node.children = [c for c in node.children if 100 * c.pages >= whole.pages]
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "shape": [written_shape(whole, counted=True)], "pages": [int(frame["pages"].sum())]})


def induced_wrappers(shapes: DataFrame) -> DataFrame:
    """One wrapper a host from (host, shape, pages), FAN shapes in a task, a written table a level."""
    level = shapes
    while True:
        counts = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if not counts.filter("n > 1").limit(1).count():
            return level
        dealt = level.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.ceil(F.col("n") / FAN)))
        level = written(dealt.groupBy("host", "part").applyInPandas(merged_shapes, "host string, shape string, pages long"), "page-wrappers")


def matched_shapes(shapes: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, shape, slots): for each node of a shape its number in the host's wrapper."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            slots = [aligned(numbered(read_shape(w)), read_shape(s)) for w, s in zip(frame["wrapper"], frame["shape"], strict=True)]
            yield pd.DataFrame({"host": frame["host"], "shape": frame["shape"], "slots": slots})

    both = shapes.select("host", "shape").join(wrappers.select("host", F.col("shape").alias("wrapper")), "host")
    return both.mapInPandas(match, "host string, shape string, slots array<int>")


def content_node(wrapper: str, weights: dict[int, int]) -> int:
    """The wrapper's node, by number, that holds the varying text; weights: characters by slot."""
    root = numbered(read_shape(wrapper))
    order = list(root.nodes())
    below = [weights.get(k, 0) for k in range(len(order))]
    for s in reversed(order):
        below[s.number] += sum(below[c.number] for c in s.children)
    at = root
    while True:
        child = next((c for c in at.children if 100 * below[c.number] >= CONTENT_PERCENT * below[at.number] > 0), None)
        if child is None or (not child.children and below[child.number] == weights.get(child.number, 0)):
            return at.number
        at = child


def host_rules(pages: DataFrame) -> DataFrame:
    """(host, wrapper, content, template_slots, template_hashes) from pages (host, html)."""
    parsed = written(parsed_pages(pages), "pages-parsed")
    shapes = written(parsed.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages")), "page-shapes")
    wrappers = induced_wrappers(shapes)
    slots = matched_shapes(shapes, wrappers)
    # copies of a page say as much as one: what many pages share is template, what is copied whole isn't
    distinct = parsed.dropDuplicates(["host", "page_hash"]).join(slots, ["host", "shape"])
    block = F.arrays_zip(F.transform("nodes", lambda k: F.get("slots", k)).alias("slot"), F.col("hashes").alias("hash"), F.col("chars").alias("chars"), F.col("links").alias("links"))
    each = written(distinct.select("host", "page_hash", F.explode(block).alias("b")).select("host", "page_hash", F.col("b.slot").alias("slot"), F.col("b.hash").alias("hash"), F.col("b.chars").alias("chars"), F.col("b.links").alias("links")), "page-blocks")
    texts = each.groupBy("host", "slot", "hash").agg(F.count_distinct("page_hash").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    texts = written(texts, "page-texts")
    counts = parsed.groupBy("host").agg(F.count_distinct("page_hash").alias("all_pages"), F.avg(F.col("article").cast("int")).alias("articles"))
    often = texts.filter((F.col("pages") >= TEMPLATE_PAGES) & (F.col("slot") >= 0)).join(counts, "host").filter(100 * F.col("pages") >= TEMPLATE_PERCENT * F.col("all_pages"))
    often = written(often.select("host", "slot", "hash", "chars", "articles"), "page-templates")
    # a row a host that has such texts
    shares = often.groupBy("host").agg(F.sum("chars").alias("template_chars"), F.first("articles").alias("articles")).join(texts.groupBy("host").agg(F.sum("chars").alias("all_chars")), "host")
    most = F.when(F.col("articles") >= 0.5, COPIED_PERCENT).otherwise(COPIED_PERCENT_WITHOUT_ARTICLE)
    copied = shares.filter(100 * F.col("template_chars") > most * F.col("all_chars")).select("host")
    often = often.select("host", "slot", "hash").join(copied, "host", "left_anti")
    # at most a page's blocks and two thirds a host
    template = often.groupBy("host").agg(F.collect_list(F.struct("slot", "hash")).alias("template"))
    varying = texts.join(often, ["host", "slot", "hash"], "left_anti").filter("slot >= 0").groupBy("host", "slot").agg(F.sum(F.col("chars") - F.col("links")).alias("weight"))
    # a row a slot of the wrapper
    weights = varying.groupBy("host").agg(F.collect_list(F.struct("slot", "weight")).alias("weights"))
    rules = wrappers.select("host", F.col("shape").alias("wrapper")).join(weights, "host", "left").join(template, "host", "left")

    @F.pandas_udf("int")
    def content(wrapper: pd.Series, slot: pd.Series, weight: pd.Series) -> pd.Series:
        return pd.Series([content_node(w, dict(zip([] if s is None else list(s), [] if n is None else list(n), strict=True))) for w, s, n in zip(wrapper, slot, weight, strict=True)])

    found = content("wrapper", F.col("weights.slot"), F.col("weights.weight"))
    return written(rules.select("host", "wrapper", found.alias("content"), F.col("template.slot").alias("template_slots"), F.col("template.hash").alias("template_hashes")), "page-rules")


class HostRule:
    """What is known of a host: its wrapper, the nodes below its content, its template texts; slots of shapes seen."""

    def __init__(self, wrapper: str | None, content: int | None, slots: list[int] | None, hashes: list[int] | None):
        self.wrapper = numbered(read_shape(wrapper)) if wrapper else None
        self.template = set(zip(slots or [], hashes or [], strict=True))
        order = list(self.wrapper.nodes()) if self.wrapper else []
        inside = next((s for s in order if s.number == content), self.wrapper)
        self.content = {s.number for s in inside.nodes()} if inside else set()
        self.seen: dict[str, list[int]] = {}

    def slots(self, text: str, shape) -> list[int]:
        if text not in self.seen:
            if len(self.seen) >= 256:
                self.seen.clear()
            self.seen[text] = aligned(self.wrapper, shape) if self.wrapper else [-1] * sum(1 for _ in shape.nodes())
        return self.seen[text]


def main_text(page: str, rule: HostRule) -> str:
    root, blocks = read_page(page)
    wanted, article = wanted_blocks(blocks)
    if not wanted:
        return ""
    if not rule.template and article:
        return "\n".join(blocks[k].text for k in wanted)
    shape, made = shape_of(root)
    place = {id(s): k for k, s in enumerate(shape.nodes())}
    slots = rule.slots(written_shape(shape), shape)

    def slot(node: Node) -> int:
        return slots[place[id(made[id(node)].found())]]

    def is_content(block: Block) -> bool:
        if (slot(block.node), text_hash(block.text)) in rule.template:
            return False
        if article:
            return True
        near = next((s for s in map(slot, lines_of(block.node)) if s >= 0), -1)
        return (near < 0 or near in rule.content) and 100 * block.linked <= LINK_PERCENT * len(block.text)

    return "\n".join(blocks[k].text for k in wanted if is_content(blocks[k]))


def extract_main_text(pages: DataFrame, url: str = "url", page: str = "html", text: str = "text") -> DataFrame:
    """The columns of pages but the html, and text: the main text of the whole html, blocks joined by line feeds.

    Character references are decoded and white space inside a block becomes one space. A null or empty html has
    an empty text, as has a page without content. Pages with a null url or one without host are one host's. Rows
    that repeat are judged alike; copies of a page count once in what is template. A very long page is read whole.
    A host with fewer than TEMPLATE_PAGES distinct pages has no template texts, nor has one whose pages are all edits of one
    (COPIED_PERCENT). An empty table gives no rows. A
    column of pages named like text is replaced.
    """
    kept = [c for c in pages.columns if c != page and c.lower() != text.lower()]
    host, wrapper, content, slots, hashes = unused(pages, "_host", "_wrapper", "_content", "_slots", "_hashes")
    rules = host_rules(pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").cast("string").alias("html")))
    size = rules.agg(F.sum(F.octet_length("wrapper") + 12 * F.coalesce(F.size("template_slots"), F.lit(0)) + F.octet_length("host") + 64).alias("n")).first()["n"] or 0
    rules = rules.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper), F.col("content").alias(content), F.col("template_slots").alias(slots), F.col("template_hashes").alias(hashes))
    rows = pages.withColumn(host, host_of(F.col(f"`{url}`")))
    joined = rows.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, host, "left")
    own = [F.col(f"`{c}`") for c in kept]
    given = joined.select(*own, F.col(f"`{page}`").cast("string").alias(page), wrapper, content, slots, hashes)
    schema = given.select(*own, F.lit("").alias(text)).schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, HostRule] = {}
        for batch in steps_of(batches):
            html, *rule_columns = batch.columns[len(kept) :]
            texts = []
            for k in range(batch.num_rows):
                w, c, s, h = (column[k].as_py() for column in rule_columns)
                key = (w, c, tuple(s or ()), tuple(h or ()))
                if key not in seen:
                    if len(seen) >= 64:
                        seen.clear()
                    seen[key] = HostRule(w, c, s, h)
                texts.append(main_text(html[k].as_py() or "", seen[key]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, text])

    return given.mapInArrow(extract, schema)


#: DuckDB SQL with the rows of the query over pages, for pages with one article of headings and paragraphs, as these are.
ORACLE = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS article FROM pages
), split AS (
  SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(article, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:p|h1)>') AS parts FROM articles
), decoded AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM split
), joined AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)), '') AS text FROM decoded
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
"""
