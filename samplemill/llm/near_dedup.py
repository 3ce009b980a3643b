"""Near-duplicate documents: banded MinHash, odd sketches, then full shingle sets.

A document's set is its distinct 5-word shingles. Documents with equal sets fall into one class at
once, so groups of copies cost a row each. Every class gets MinHash samples; bands of samples name
candidates, and the samples are folded into an odd sketch: a bitmap in which each sample flips one
bit, so that the population count of the XOR of two sketches estimates how many samples differ.
Candidates whose sketches lie too far apart are dropped, all others are confirmed on full sets.

Each member is held against one pivot of its bucket, the member that shares most buckets. Jaccard distance
is a metric: if a member has at least CORE_PERCENT in common with the pivot, whatever links with it is no
further from the pivot than both distances together: pairs of a pivot and a member are let through up to
that distance, first by their sketches (`star_limit`), then by their full sets. So such members leave the bucket, the others meet a second
pivot, and only those that two pivots left over are compared by their sketches: few of a bucket in a join, many
in blocks inside tasks, of which a row a member comes out that says with whom it hangs together.
All pairs that passed the sketches make clusters. Where links don't already join a whole cluster, blocks
of its members are compared on full sets inside tasks, components against other components, and again a row
a member comes out, however many links it has. What can be lost is what the bands and the sketches lose by chance: a pair at the threshold
shares no bucket with odds of 2 in 10 million, and its sketches lie too far apart with odds below a
billionth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components, extended_components
from .common import unused, use_memo, written

SHINGLE_WORDS = 5
#: Link where 100 * intersection >= LINK_PERCENT * union.
LINK_PERCENT = 85
BANDS, BAND_ROWS = 26, 5
#: Members that have so much in common with a pivot leave its bucket.
CORE_PERCENT = 70
#: Members of one pivot that a task reads, and the part of all pairs beyond which a pivot is split so.
PIVOT_MEMBERS, HEAVY_PARTS = 1024, 1000
PIVOT_ROUNDS = 2
#: What pivots left over in a bucket is compared pair by pair in a join up to so many members, in blocks beyond.
PAIR_MEMBERS = 16
#: Members of a cluster that a task compares with as many others, and shingles it counts in one step.
BLOCK_MEMBERS, STEP_SHINGLES = 1024, 4096
SKETCH_WORDS = 8
#: Words whose hash a worker keeps.
MEMO_WORDS = 250_000
#: Characters of text that are hashed in one step.
STEP_CHARS = 4_000_000

_U = np.uint64
_MIX_1, _MIX_2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_PLACES = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_word_hashes: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX_1
    x = (x ^ (x >> _U(27))) * _MIX_2
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words [^\\x20\\x09-\\x0D]+ as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def forget_words() -> None:
    _word_hashes.clear()


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles' 64-bit hashes in order; fewer words than size are one shingle."""
    import xxhash

    words, memo = words_of(text), _word_hashes
    if not words:
        return np.empty(0, np.uint64)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    rows = len(h) - n + 1
    total = np.full(rows, n, np.uint64)
    for j in range(n):
        total = mix(total + h[j : j + rows] * _PLACES[j])
    return np.unique(total)


def signatures(sets: list[np.ndarray], bands: int, band_rows: int, sketch_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches) of non-empty sets: int64 arrays of bands and of sketch_words columns."""
    samples, bits = bands * band_rows, 64 * sketch_words
    rng = np.random.default_rng(samples)
    flips, factors = rng.integers(0, 2**63, samples, dtype=np.uint64), rng.integers(0, 2**63, samples, dtype=np.uint64) * _U(2) + _U(1)
    flat, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    least = np.empty((samples, len(sets)), np.uint64)
    for i in range(samples):
        least[i] = np.minimum.reduceat((flat ^ flips[i]) * factors[i], starts)
    keys = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for row in least[b * band_rows : (b + 1) * band_rows]:
            key = mix(key * _PLACES[0] + row)
        keys[:, b] = key
    parity, docs = np.zeros((len(sets), bits), np.uint8), np.arange(len(sets))
    for i in range(samples):
        parity[docs, (mix(least[i] + flips[i]) % _U(bits)).astype(np.int64)] ^= 1
    return keys.view(np.int64), np.packbits(parity, axis=1).view(np.int64)


def odd_limit(samples: int, bits: int, percent: int) -> int:
    """Bits that the sketches of a linked pair differ in at most, but for odds below a billionth.

    Differing samples are binomial and each flips a bit in either sketch; six deviations are allowed
    for the samples and three for the bits that fall together.
    """
    p = 1 - percent / 100
    differing = samples * p + 6 * math.sqrt(samples * p * (1 - p))
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differing))
    return math.ceil(mean + 3 * math.sqrt(mean * (1 - mean / bits)))


def star_percent(percent: int) -> int:
    """What a document has in common with a pivot at least if it links with a member near the pivot."""
    return max(0, CORE_PERCENT + percent - 100)


def star_limit(samples: int, bits: int, percent: int) -> int:
    """Bits that the sketches of such a document and the pivot may differ in."""
    return odd_limit(samples, bits, star_percent(percent))


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def document_sets(docs: DataFrame, size: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS, sketch_words: int = SKETCH_WORDS) -> DataFrame:
    """A row a document: doc_id, text_hash, n_shingles, set_key (128-bit; null for empty sets), bands, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        use_memo("near_dedup", forget_words)
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                sets, chars, began = [], 0, at
                while at < batch.num_rows and chars < STEP_CHARS:
                    text = texts[at].as_py()
                    sets.append(shingle_set(text, size))
                    chars += len(text or "")
                    at += 1
                full = [k for k, s in enumerate(sets) if len(s)]
                keys, sketches = np.zeros((len(sets), bands), np.int64), np.zeros((len(sets), sketch_words), np.int64)
                if full:
                    keys[full], sketches[full] = signatures([sets[k] for k in full], bands, band_rows, sketch_words)
                rows = np.arange(len(sets) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(began, at - began),
                        batch.column(2).slice(began, at - began),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(rows * bands, pa.array(keys.ravel())),
                        pa.ListArray.from_arrays(rows * sketch_words, pa.array(sketches.ravel())),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "set_key", "bands", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("text_hash"))
    return rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, set_key, shingles (array of 64-bit hashes) of each document with words."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        use_memo("near_dedup", forget_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), size) for t in some.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))],
                    ["doc_id", "set_key", "shingles"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(hashes, "doc_id long, set_key binary, shingles array<long>")


def _apart(a: str, b: str, words: int) -> Column:
    """Bits in which two odd sketches differ."""
    total = F.lit(0)
    for k in range(words):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def _similar(pairs: DataFrame, sets: DataFrame, percents: dict[str, int]) -> DataFrame:
    """The pairs (u, v) with, for each name, whether their full sets are so similar."""
    counts = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.count(F.lit(1)).alias("t")).scalar()
    # pivots with a large part of all pairs, fewer than HEAVY_PARTS: members dealt by hash, the pivot's set to each share
    heavy = counts.filter((F.col("n") > PIVOT_MEMBERS) & (F.col("n") * HEAVY_PARTS > total)).limit(HEAVY_PARTS)
    heavy = F.broadcast(heavy.select(F.col("u").alias("heavy"), F.ceil(F.col("n") / PIVOT_MEMBERS).cast("int").alias("shares")))
    shares = F.coalesce("shares", F.lit(1))
    left = sets.select(F.col("set_key").alias("u"), F.col("shingles").alias("u_set")).join(heavy, F.col("u") == F.col("heavy"), "left")
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).select("u", "share", "u_set")
    right = sets.select(F.col("set_key").alias("v"), F.col("shingles").alias("v_set"))
    dealt = pairs.join(heavy, F.col("u") == F.col("heavy"), "left").withColumn("share", F.pmod(F.xxhash64("v"), shares).cast("int")).select("u", "v", "share")
    both = dealt.join(right, "v").join(left, ["u", "share"]).withColumn("shared", F.size(F.array_intersect("u_set", "v_set")).cast("long"))
    union = F.size("u_set") + F.size("v_set") - F.col("shared")
    return both.select("u", "v", *[(100 * F.col("shared") >= percent * union).alias(name) for name, percent in percents.items()])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, over steps of common shingles."""
    flat = np.concatenate([*left, *right])
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    common = n[column] > 1
    rows, column = rows[common], number[column[common]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, STEP_SHINGLES):
        a, b = np.searchsorted(column, [first, first + STEP_SHINGLES])
        held = np.zeros((len(left) + len(right), STEP_SHINGLES), np.float32)
        held[rows[a:b], column[a:b] - first] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out.astype(np.int64)


def bits_apart(left: list, right: list) -> np.ndarray:
    """Bits in which each left and each right odd sketch differ."""
    a, b = np.stack(left).view(np.uint64), np.stack(right).view(np.uint64)
    apart = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        apart += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return apart


def roots(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links between them the first row it hangs together with; -1 without a link."""
    rows, columns = np.full(met.shape[0], -1), np.full(met.shape[1], -1)
    for first in np.flatnonzero(met.any(axis=1)):
        if rows[first] >= 0:
            continue
        front, rows[first] = np.array([first]), first
        while len(front):
            new = np.flatnonzero((columns < 0) & met[front].any(axis=0))
            columns[new] = first
            front = np.flatnonzero((rows < 0) & met[:, new].any(axis=1))
            rows[front] = first
    return rows, columns


def _root_links(met: np.ndarray, left: list, right: list) -> pd.DataFrame:
    """Links (u, v) that join what met joins, one a member at most."""
    found = {(left[r], name) for names, own in zip((left, right), roots(met), strict=True) for name, r in zip(names, own.tolist(), strict=True) if r >= 0 and left[r] != name}
    return pd.DataFrame(list(found), columns=["u", "v"])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows (set_key, n: rows of their bucket or cluster) once for each pair (i, j) of blocks that their own is one of."""
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    met = dealt.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("n", "blocks", "other")


def rest_links(rest: DataFrame, near: int, sketch_words: int = SKETCH_WORDS) -> DataFrame:
    """Links (u, v) that join what pairs of one bucket with sketches at most near bits apart join.

    rest: bucket, n (its rows), set_key, sketch. No more than a row a member, bucket and block comes out of
    buckets with more than PAIR_MEMBERS members; each pair of their members is compared, none becomes a row.
    """
    few, many = rest.filter(F.col("n") <= PAIR_MEMBERS), rest.filter(F.col("n") > PAIR_MEMBERS)
    a = few.select("bucket", F.col("set_key").alias("u"), F.col("sketch").alias("u_sketch"))
    b = few.select("bucket", F.col("set_key").alias("v"), F.col("sketch").alias("v_sketch"))
    pairs = a.join(b, (a["bucket"] == b["bucket"]) & (F.col("u") < F.col("v")) & (_apart("u_sketch", "v_sketch", sketch_words) <= near)).select("u", "v")

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("set_key")  # so that a bucket's root is another's too
        first, second = (frame[frame["own"] == frame[side].iloc[0]] for side in ("i", "j"))
        if not len(first) or not len(second):
            return pd.DataFrame({"u": [], "v": []})
        met = bits_apart(first["sketch"].tolist(), second["sketch"].tolist()) <= near
        return _root_links(met, *[[bytes(k) for k in side["set_key"]] for side in (first, second)])

    blocks = _in_blocks(many).groupBy("bucket", "i", "j").applyInPandas(links, "u binary, v binary")
    return pairs.union(blocks).distinct()


def block_links(left: dict, right: dict, same: bool, near: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs between members of different components; dicts of component, sketch, sets."""
    wanted = (bits_apart(left["sketch"], right["sketch"]) <= near) & (np.asarray(left["component"])[:, None] != np.asarray(right["component"])[None])
    if same:
        wanted = np.triu(wanted, 1)
    i, j = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(i):
        return i, j
    some_left, some_right = [left["sets"][k] for k in i], [right["sets"][k] for k in j]
    shared = shared_counts(some_left, some_right)
    sizes = np.array([len(x) for x in some_left])[:, None] + np.array([len(x) for x in some_right])[None]
    found = np.nonzero(wanted[np.ix_(i, j)] & (100 * shared >= percent * (sizes - shared)))
    return i[found[0]], j[found[1]]


def _within_clusters(clusters: DataFrame, components: DataFrame, classes: DataFrame, sets: DataFrame, near: int, percent: int) -> DataFrame:
    """Links (u, v) that join what links between members of a cluster whose components differ join."""
    own = clusters.select(F.col("node").alias("set_key"), F.col("component").alias("cluster"))
    placed = own.join(components.select(F.col("node").alias("set_key"), "component"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    mixed = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    members = placed.join(mixed.select("cluster", "n"), "cluster").join(classes.select("set_key", "sketch"), "set_key").join(sets.select("set_key", "shingles"), "set_key")
    pairs = _in_blocks(members)

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        first, second = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        sides = [frame[frame["own"] == k] for k in (first, second)]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"u": [], "v": []})
        keys = [[bytes(k) for k in side["set_key"]] for side in sides]
        held = [{"component": np.array([bytes(c).hex() for c in side["component"]]), "sketch": side["sketch"].tolist(), "sets": side["shingles"].tolist()} for side in sides]
        i, j = block_links(*held, first == second, near, percent)
        met = np.zeros((len(keys[0]), len(keys[1])), bool)
        met[i, j] = True
        if first == second:  # each with itself, and both ways
            met |= met.T
            met |= np.eye(len(met), dtype=bool) & met.any(axis=1)
        return _root_links(met, *keys)

    return pairs.groupBy("cluster", "i", "j").applyInPandas(links, "u binary, v binary")


def _class_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(set_key, shingles) of each class that shares a bucket, once, from one more pass over the texts that stand for one."""
    wanted = members.filter("first is not null").select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")).hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (_text_hash() == F.col("first_hash"))
    sets = written(full_sets(docs.select("doc_id", "text").filter("text is not null").join(wanted, same, "left_semi"), size), "near-texts").select("set_key", "shingles")
    # rows that repeat doc_id and text have one set each
    again = sets.groupBy("set_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("set_key")
    if again.isEmpty():
        return sets
    return written(sets.join(again, "set_key", "left_anti").union(sets.join(again, "set_key", "left_semi").dropDuplicates(["set_key"])), "near-sets")


def near_duplicates(docs: DataFrame, percent: int = LINK_PERCENT, shingle_words: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS, sketch_words: int = SKETCH_WORDS) -> DataFrame:
    """Groups of near-duplicates among docs (doc_id, text).

    Returns doc_id, n_shingles (size of the document's set), component_id (smallest doc_id that
    links reach, itself included), kept (doc_id = component_id), set_key (its class of equal sets),
    text_hash (64-bit hash of the text) and group (the same for all rows of a group; null for empty sets).

    A null or empty text, or one without words, has an empty set and is linked with nothing. A null
    doc_id stays null; its document links others and is kept only if none in its group has an id
    (component_id is null then). Rows that repeat a doc_id are documents with the same id. Very long
    texts are hashed whole. An empty table gives an empty result. Columns besides doc_id and text
    aren't read.
    """
    signed = written(document_sets(docs, shingle_words, bands, band_rows, sketch_words), "near-signed")
    # first: a row of the class whose text stands for it
    classes = signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes, "near-classes")
    buckets = classes.select(F.explode("bands").alias("bucket"), "set_key")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a class has a row a band at most, so its window is small; first is kept in one of them
    own = Window.partitionBy("set_key")
    members = buckets.join(shared, "bucket").join(classes.select("set_key", "first", "sketch"), "set_key")
    members = members.withColumn("reach", F.sum("n").over(own)).withColumn("first", F.when(F.col("bucket") == F.min("bucket").over(own), F.col("first")))
    members = written(members.select("bucket", "set_key", "first", "sketch", "reach"), "near-members")
    near = odd_limit(bands * band_rows, 64 * sketch_words, percent)
    far = star_limit(bands * band_rows, 64 * sketch_words, percent)

    sets = _class_sets(docs, members, shingle_words)

    left, candidates, links = members.select("bucket", "set_key", "sketch", "reach"), None, None
    for _ in range(PIVOT_ROUNDS):
        pivots = left.groupBy("bucket").agg(F.max(F.struct("reach", "set_key", "sketch")).alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        pivots = pivots.select("bucket", F.col("pivot.set_key").alias("u"), F.col("pivot.sketch").alias("u_sketch"))
        placed = left.join(pivots, "bucket").filter("set_key != u").withColumnsRenamed({"set_key": "v", "sketch": "v_sketch"})
        stars = written(placed.filter(_apart("u_sketch", "v_sketch", sketch_words) <= far).select("u", "v").distinct(), "near-pairs")
        stars = written(_similar(stars, sets, {"linked": percent, "core": CORE_PERCENT, "reachable": star_percent(percent)}), "near-stars")
        # only what can link with a member near the pivot needs its cluster
        reachable = stars.filter("reachable").select("u", "v")
        candidates = reachable if candidates is None else candidates.union(reachable)
        found = stars.filter("linked").select("u", "v")
        links = found if links is None else links.union(found)
        left = placed.join(stars.filter("core").select("u", "v"), ["u", "v"], "left_anti").select("bucket", F.col("v").alias("set_key"), F.col("v_sketch").alias("sketch"), "reach")
        left = written(left, "near-left")

    rest = left.join(left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket")
    across = rest_links(written(rest.select("bucket", "n", "set_key", "sketch"), "near-rest"), near, sketch_words)
    components = written(connected_components(links, stored=True), "near-components")
    # clusters: components that candidates lead between
    clusters = written(extended_components(components, candidates.union(across)), "near-clusters")
    more = written(_within_clusters(clusters, components, classes, sets, near, percent), "near-links")
    if not more.isEmpty():
        components = extended_components(components, more)

    found = classes.select("set_key", "least_id").join(components.select(F.col("node").alias("set_key"), "component"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    smallest = found.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = found.join(smallest, "component").select("set_key", "component_id", F.col("component").alias("group"))
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "set_key", "text_hash", "group")


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each group of near-duplicates, and all rows without words; all columns stay.

    The row with the smallest doc_id stays (a null one only if none in its group has an id), then the one
    with the smallest hash of its text; of rows that repeat both, any one. Rows are told apart by doc_id
    and text, so rows with a null or repeated doc_id go or stay each for itself.
    """
    found = near_duplicates(docs, **parameters).filter("group is not null").select("group", "doc_id", "text_hash")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    keys = found.groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = keys.groupBy("group").agg(F.min(order).alias("first"), F.sum("n").alias("rows")).filter("rows > 1").select("group", "first")
    placed = keys.join(first, "group").withColumn("stays", order == F.col("first")).filter("not stays or n > 1")
    text_hash, decided_id, decided_hash, stays = unused(docs, "_text_hash", "_id", "_hash", "_stays")
    decided = written(placed.select(F.col("doc_id").alias(decided_id), F.col("text_hash").alias(decided_hash), F.col("stays").alias(stays)), "near-decided")
    own = docs.withColumn(text_hash, _text_hash())
    same = own["doc_id"].eqNullSafe(decided[decided_id]) & (own[text_hash] == decided[decided_hash])
    out = own.join(decided, same, "left_anti")
    again = decided.filter(stays)
    if not again.isEmpty():  # rows that repeat a whole key
        out = out.unionByName(own.join(again, same, "left_semi").dropDuplicates(["doc_id", text_hash]))
    return out.drop(text_hash)


#: DuckDB SQL with the rows of the query over documents: pairs of classes that share one of their rarest shingles, as many
#: as a linked pair must share one of, each confirmed on its whole lists.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM words
), keyed AS (
  SELECT *, md5(array_to_string(list_sort(shingles), chr(1))) AS k FROM sets
), classes AS (
  SELECT k, min(doc_id) AS c, any_value(shingles) AS shingles, any_value(len(shingles)) AS n FROM keyed WHERE len(shingles) > 0 GROUP BY k
), each AS (
  SELECT c, n, unnest(shingles) AS g FROM classes
), common AS (
  SELECT g, count(*) AS f FROM each GROUP BY g
), first AS (
  SELECT c, n, g FROM each JOIN common USING (g) QUALIFY row_number() OVER (PARTITION BY c ORDER BY f, g) <= n - (85 * n + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT a.c AS u, b.c AS v FROM first a JOIN first b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), met AS (
  SELECT u, v, a.n + b.n AS sizes, len(list_intersect(a.shingles, b.shingles)) AS shared FROM pairs JOIN classes a ON a.c = u JOIN classes b ON b.c = v
), links AS (
  SELECT u, v FROM met WHERE 100 * shared >= 85 * (sizes - shared)
), sides AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached(c, r) AS (
  SELECT c, c FROM classes UNION SELECT sides.v, reached.r FROM reached JOIN sides ON sides.u = reached.c
), least AS (
  SELECT c, min(r) AS component FROM reached GROUP BY c
)
SELECT doc_id, len(keyed.shingles)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM keyed LEFT JOIN classes ON classes.k = keyed.k AND len(keyed.shingles) > 0 LEFT JOIN least ON least.c = classes.c
"""
