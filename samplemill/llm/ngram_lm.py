"""Interpolated modified Kneser-Ney n-gram model: counted over Spark's shuffle, stored as sorted hash arrays.

Words are 64-bit hashes, and ids once all are known: a word's place in the sorted hashes. Counting goes
from the words to the n-grams of the model's order, and from there down, an order a step:

    words    -> shards of sorted word hashes with counts
    n-grams  -> shards by a hash of the context: sorted hashes of n-grams with counts, sorted hashes of
                contexts with what each needs: its total and how many words followed it once, twice, three
                times or more; and each n-gram without its first word, for the next lower order, which
                counts how many different words stood before it (or, at the start of a text, how often)
    words    -> for each word, how many different words it followed

A task sums up its own run first, so a word pair in a third of all documents costs a row a task. Runs meet
in a tree: each step deals a run to FAN ranges at most and merges FAN runs of a range, until a range is one
shard. So rows grow with the corpus and not with runs times shards, and shards grow in number only. Each
shard is files of plain sorted arrays in the shared folder, which workers map into memory: a score is a
few binary searches and no worker holds the model.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_uri, file_system, new_folder, use_memo, write_atomically, written
from .near_dedup import mix

#: Words of an n-gram.
ORDER = 2
#: Tokens that a shard counts, as expected, and that a task sums up before it hands them on.
SHARD_TOKENS = 8_000_000
RUN_TOKENS = 4_000_000
#: Ranges that a run is dealt to in one step, and runs that a step merges.
FAN = 64
MEMO_WORDS = 1_000_000
#: Tokens that are scored in one step.
STEP_TOKENS = 500_000
#: The end of a text: not a word, as it holds a blank.
END = b" end"

_U = np.uint64
_hashes: dict[bytes, int] = {}


def hashed(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def forget_hashes() -> None:
    _hashes.clear()


def token_hashes(text: str | None, most: int = -1) -> np.ndarray:
    """Hashes of A-Z lower-cased words [^\\x20\\x09-\\x0D]+ and of the end; of the first `most` of these only, if given."""
    words = text.encode("utf-8", "surrogatepass").lower().split(None, most) if text else []
    memo = _hashes
    if len(memo) > MEMO_WORDS:
        memo.clear()
    words.append(END)
    if most >= 0:
        words = words[:most]
    try:
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    except KeyError:
        memo.update((w, hashed(w)) for w in set(words) if w not in memo)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers: differences, byte planes apart, compressed."""
    import zstandard

    steps = np.diff(values, prepend=_U(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    import zstandard

    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


_PLACES = np.random.default_rng(9).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def code(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of ids."""
    total = np.full(len(grams), grams.shape[1], np.uint64)
    for j in range(grams.shape[1]):
        total = mix(total + (grams[:, j] + _U(1)) * _PLACES[j])
    return total


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and the sums of their counts. Rows of one column may be any 64-bit numbers, else
    they are ids below 2**32."""
    if not len(grams):
        return grams, counts
    keys = _paired(grams)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    changed = np.zeros(len(grams) - 1, bool)
    for k in keys:
        changed |= k[order[1:]] != k[order[:-1]]
    first = np.flatnonzero(np.concatenate([[True], changed]))
    return grams[order[first]], np.add.reduceat(counts[order], first)


def _paired(grams: np.ndarray) -> list[np.ndarray]:
    """The first two columns in one number, then each other column."""
    if grams.shape[1] == 1:
        return [grams[:, 0]]
    return [grams[:, 0] << _U(32) | grams[:, 1], *(grams[:, j] for j in range(2, grams.shape[1]))]


def pack_grams(grams: np.ndarray) -> bytes:
    """Sorted distinct rows: the first two columns as differences, the others as they are."""
    first, *others = _paired(grams)
    parts = [pack_sorted(first), *map(pack_counts, others)]
    return b"".join(struct.pack("<Q", len(p)) + p for p in parts)


def unpack_grams(data: bytes, columns: int) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        parts.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    first = unpack_sorted(parts[0])
    if columns == 1:
        return first[:, None]
    return np.stack([first >> _U(32), first & _U(2**32 - 1), *(unpack_counts(p).astype(np.uint64) for p in parts[1:])], axis=1)


_RUN = "range long, keys binary, counts binary"


def _run(grams: np.ndarray, counts: np.ndarray, shard: np.ndarray, step: int) -> pd.DataFrame:
    """A row for each range of `step` shards that has some of the sorted rows."""
    ranges = shard // step
    order = np.argsort(ranges, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(ranges[order]) != 0])).tolist() if len(order) else []
    some = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
    return pd.DataFrame([(int(ranges[k[0]]), pack_grams(grams[k]), pack_counts(counts[k])) for k in some], columns=["range", "keys", "counts"])


def _merged(frame: pd.DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([unpack_grams(k, columns) for k in frame["keys"]]), np.concatenate([unpack_counts(c) for c in frame["counts"]]))


def first_step(shards: int) -> int:
    """Shards of a range that runs are dealt to first."""
    step = 1
    while step * FAN < shards:
        step *= FAN
    return step


def merged_by_shard(runs: DataFrame, columns: int, shards: int, pieces: int, shard_of, store, schema: str) -> DataFrame:
    """store(frame of one shard) over runs in ranges of first_step(shards), by way of finer and finer ranges.
    pieces: about how many runs there are."""

    def dealt_to(step: int):
        def deal(frame: pd.DataFrame) -> pd.DataFrame:
            grams, counts = _merged(frame, columns)
            return _run(grams, counts, shard_of(grams), step)

        return deal

    step = first_step(shards)
    while step > 1:
        step, pieces = step // FAN, -(-pieces // FAN)
        runs = runs.withColumn("lot", F.pmod(F.xxhash64("keys"), F.lit(pieces))).groupBy("range", "lot").applyInPandas(dealt_to(step), _RUN)
    return runs.groupBy("range").applyInPandas(store, schema)


@lru_cache(maxsize=4096)
def mapped(path: str, kind: str) -> np.ndarray:
    """A file of numbers, mapped into memory; from a store that isn't a mounted folder by way of an
    unnamed local file, which ends with the worker."""
    uri = as_uri(path)
    if uri.startswith("file://"):
        return np.memmap(uri.removeprefix("file://"), kind, "r")
    system, at = file_system(path)
    with tempfile.TemporaryFile() as local, system.open_input_stream(at) as source:
        while some := source.read(1 << 24):
            local.write(some)
        local.flush()
        return np.frombuffer(mmap.mmap(local.fileno(), 0, access=mmap.ACCESS_READ), kind)


def _found_at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted key in sorted keys, whether it is there)."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass(frozen=True)
class NgramModel:
    """Where the arrays lie and the model's few numbers.

    discounts: for counts of one, two, and three or more, of each order from 1 on. lower_classes: how many
    words followed one, two, three or more words. types: pairs of words.
    """

    folder: str
    order: int
    shards: int
    words: int
    tokens: int
    documents: int
    discounts: tuple[tuple[float, float, float], ...] = ()
    lower_classes: tuple[int, int, int] = (0, 0, 0)
    types: int = 0

    @property
    def start(self) -> int:
        """The id that stands for the start of a text."""
        return self.words

    @property
    def offsets(self) -> np.ndarray:
        """The first id of each shard of words."""
        return mapped(f"{self.folder}/offsets", "<i8")

    def shard_of_words(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(shard_bounds(self.shards), hashes, side="right")

    def shard_of_ids(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets[1:-1], ids, side="right")

    def shard_of_grams(self, grams: np.ndarray) -> np.ndarray:
        """The shard of rows of ids: that of their first ones', the context's, hash."""
        return self.shard_of_words(code(grams[:, :-1]))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by hash; -1: unknown."""
        wanted, back = np.unique(hashes, return_inverse=True)
        out, offsets, shard = np.full(len(wanted), -1, np.int64), self.offsets, self.shard_of_words(wanted)
        for s in np.unique(shard).tolist():
            if offsets[s + 1] > offsets[s]:
                own = np.flatnonzero(shard == s)
                at, there = _found_at(mapped(f"{self.folder}/words-{s:06d}", "<u8"), wanted[own])
                out[own] = np.where(there, at + offsets[s], -1)
        return out[back]

    def per_word(self, name: str, kind: str, ids: np.ndarray) -> np.ndarray:
        """Values of ids from the arrays called name; 0 for id -1."""
        wanted, back = np.unique(ids, return_inverse=True)
        out, known, offsets = np.zeros(len(wanted), np.int64), np.flatnonzero(wanted >= 0), self.offsets
        shard = self.shard_of_ids(wanted[known])
        for s in np.unique(shard).tolist():
            own = known[shard == s]
            out[own] = mapped(f"{self.folder}/{name}-{s:06d}", kind)[wanted[own] - offsets[s]]
        return out[back]

    def gram_values(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, total of the context, discount left for the lower order) of rows of ids; 0 for unseen ones."""
        k, n = grams.shape[1], len(grams)
        count, total, left = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        present = mapped(f"{self.folder}/present-{k}", "<u1")
        contexts = code(grams[:, :-1])
        shard = self.shard_of_words(contexts)
        for s in np.unique(shard).tolist():
            if not present[s]:
                continue
            own = np.flatnonzero(shard == s)
            array = lambda name, kind: mapped(f"{self.folder}/{name}-{k}-{s:06d}", kind)  # noqa: B023, E731
            wanted, back = np.unique(contexts[own], return_inverse=True)
            at, there = _found_at(array("contexts", "<u8"), wanted)
            total[own] = np.where(there, array("totals", "<i8")[at], 0)[back]
            left[own] = np.where(there, sum(d * array(f"followed{j}", "<u4")[at] for j, d in enumerate(self.discounts[k - 1], 1)), 0)[back]
            wanted, back = np.unique(code(grams[own]), return_inverse=True)
            at, there = _found_at(array("grams", "<u8"), wanted)
            count[own] = np.where(there, array("counts", "<i8")[at], 0)[back]
        return count, total, left

    def log10_probabilities(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of each word after those before it in its text; ids of texts one after the other, -1: unknown."""
        cut = lambda c, d: np.array([0.0, *d])[np.minimum(c, 3)]
        if not self.types:
            return np.full(len(ids), np.log10(1 / (self.words + 1)))
        followed = self.per_word("continuations", "<i8", ids)
        spared = np.dot(self.discounts[0], self.lower_classes)
        p = (followed - cut(followed, self.discounts[0]) + spared / (self.words + 1)) / self.types
        place = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
        for k in range(2, self.order + 1):
            at, grams, known = _grams_at(ids, place, k, self.start)
            count, total, left = self.gram_values(grams[known].astype(np.uint64))
            seen = total > 0
            own = at[known][seen]
            p[own] = (count[seen] - cut(count[seen], self.discounts[k - 1]) + left[seen] * p[own]) / total[seen]
        return np.log10(p)


def _grams_at(ids: np.ndarray, place: np.ndarray, k: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in ids with k - 1 words or the start before them, those k ids each, whether all but the last are known)."""
    at = np.flatnonzero(place >= k - 2)
    grams = np.stack([ids[np.maximum(at - j, 0)] for j in range(k - 1, -1, -1)], axis=1)
    grams[place[at] == k - 2, 0] = start
    return at, np.where(grams < 0, 2**32 - 1, grams), (grams[:, :-1] >= 0).all(axis=1)


def shard_bounds(shards: int) -> np.ndarray:
    return np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many were seen once to four times; where these are too few
    to say, one half for each count."""
    n1, n2, n3, n4 = n
    if 0 in (n1, n2, n3):
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k else k / 2 for k, d in enumerate(found, 1))


def _text_steps(batches: Iterator[pd.DataFrame], most: int = -1) -> Iterator[list[np.ndarray]]:
    """Lists of the token hashes of texts, RUN_TOKENS or a little more each."""
    held, n = [], 0
    for batch in batches:
        for text in batch["text"]:
            held.append(token_hashes(text, most))
            n += len(held[-1])
            if n >= RUN_TOKENS:
                yield held
                held, n = [], 0
    if held:
        yield held


def write_grams(folder: str, k: int, shard: int, grams: np.ndarray, counts: np.ndarray) -> None:
    """A shard's arrays of n-grams of k words, distinct rows of ids in order, and of their contexts."""
    put = lambda name, values, kind: write_atomically(f"{folder}/{name}-{k}-{shard:06d}", [values.astype(kind).tobytes()])
    codes, contexts = code(grams), code(grams[:, :-1])
    by_code = np.argsort(codes, kind="stable")
    put("grams", codes[by_code], "<u8")
    put("counts", counts[by_code], "<i8")
    keys, of = np.unique(contexts, return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, of, counts)
    put("contexts", keys, "<u8")
    put("totals", totals, "<i8")
    for j in (1, 2, 3):  # different words, fewer than 2**32
        put(f"followed{j}", np.bincount(of[np.minimum(counts, 3) == j], minlength=len(keys)), "<u4")


def train(texts: DataFrame, shard_tokens: int = SHARD_TOKENS, folder: str | None = None, order: int = ORDER) -> NgramModel:
    """Count the whole texts of texts (text; null: empty) and write the model's arrays to the shared folder.

    order: words of an n-gram, two or more. Only a few numbers a shard reach the driver. Repeated rows count
    each. No rows: a model that knows no word. 2**32 - 1 different words or more raise. Other columns aren't read.
    """
    if order < 2:
        raise ValueError("order is below two")
    spark = texts.sparkSession
    folder = folder or new_folder(spark, "ngrams")
    rows = texts.select(F.col("text").cast("string").alias("text"))
    # as many shards as the words want that white space suggests
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 6), F.count(F.lit(1))).first()
    tokens = int(size[0] or 0) // 6
    shards, documents = max(1, -(-tokens // shard_tokens)), int(size[1])
    step, pieces = first_step(shards), max(1, tokens // RUN_TOKENS)
    one = lambda values: values[:, None]
    model = NgramModel(folder, order, shards, 0, 0, documents)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_memo("ngram_lm", forget_hashes)
        for held in _text_steps(batches):
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield _run(one(keys), counts, model.shard_of_words(keys), step)

    def store_words(frame: pd.DataFrame) -> pd.DataFrame:
        s = int(frame["range"].iloc[0])
        keys, counts = _merged(frame, 1)
        write_atomically(f"{folder}/words-{s:06d}", [keys.astype("<u8").tobytes()])
        write_atomically(f"{folder}/counts-{s:06d}", [counts.astype("<i8").tobytes()])
        return pd.DataFrame({"shard": [s], "n": [len(keys)], "tokens": [counts.sum()]})

    found = merged_by_shard(rows.mapInPandas(words, _RUN), 1, shards, pieces, lambda g: model.shard_of_words(g[:, 0]), store_words, "shard long, n long, tokens long").collect()
    sizes = np.zeros(shards, np.int64)
    for r in found:
        sizes[r["shard"]] = r["n"]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= (1 << 32) - 1:
        raise ValueError("more than 2**32 different words")
    write_atomically(f"{folder}/offsets", [offsets.astype("<i8").tobytes()])
    model = NgramModel(folder, order, shards, int(offsets[-1]), sum(r["tokens"] for r in found), documents)
    if not documents:
        return model

    def grams_of(k: int, heads: bool):
        def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The n-grams of k words; with heads only those at the start of a text."""
            use_memo("ngram_lm", forget_hashes)
            for held in _text_steps(batches, k - 1 if heads else -1):
                ids, lengths = model.ids(np.concatenate(held)), [len(x) for x in held]
                place = np.arange(len(ids)) - np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
                if heads:
                    place = np.where(place == k - 2, place, -1)
                _, found, _ = _grams_at(ids, place, k, model.start)
                found, counts = summed(found.astype(np.uint64), np.ones(len(found), np.int64))
                yield _run(found, counts, model.shard_of_grams(found), step)

        return grams

    def lower_shard(k: int, grams: np.ndarray) -> np.ndarray:
        return model.shard_of_grams(grams) if k > 1 else model.shard_of_ids(grams[:, 0].astype(np.int64))

    def storing(k: int):
        def store_grams(frame: pd.DataFrame) -> pd.DataFrame:
            s = int(frame["range"].iloc[0])
            grams, counts = _merged(frame, k)
            write_grams(folder, k, s, grams, counts)
            below, before = summed(np.ascontiguousarray(grams[:, 1:]), np.ones(len(grams), np.int64))
            out = _run(below, before, lower_shard(k - 1, below), step)
            few = [int((counts == j).sum()) for j in (1, 2, 3, 4)]
            return out.assign(source=s, n=[len(grams)] + [0] * (len(out) - 1), few=[few] + [[0] * 4] * (len(out) - 1))

        return store_grams

    def store_continuations(frame: pd.DataFrame) -> pd.DataFrame:
        s, first = int(frame["range"].iloc[0]), model.offsets
        ids, counts = _merged(frame, 1)
        followed = np.zeros(first[s + 1] - first[s], np.int64)
        followed[ids[:, 0].astype(np.int64) - first[s]] = counts
        write_atomically(f"{folder}/continuations-{s:06d}", [followed.astype("<i8").tobytes()])
        few = [int((followed == j).sum()) for j in (1, 2, 3, 4)]
        return pd.DataFrame({"few": [few], "n": [int((followed > 0).sum())]})

    runs, discounts, types = rows.mapInPandas(grams_of(order, False), _RUN), [], 0
    for k in range(order, 1, -1):
        stored = merged_by_shard(runs, k, shards, pieces, model.shard_of_grams, storing(k), f"{_RUN}, source long, n long, few array<long>")
        below = written(stored, f"grams-{k}")
        heads = below.groupBy("source").agg(F.sum("n").alias("n"), *[F.sum(F.col("few")[j]).alias(f"few_{j}") for j in range(4)]).collect()
        present = np.zeros(shards, np.uint8)
        present[[r["source"] for r in heads]] = 1
        write_atomically(f"{folder}/present-{k}", [present.tobytes()])
        discounts.append(_discounts([sum(r[f"few_{j}"] for r in heads) for j in range(4)]))
        types, pieces = sum(r["n"] for r in heads), max(pieces, shards)
        runs = below.select("range", "keys", "counts")
        if k > 2:
            runs = runs.union(rows.mapInPandas(grams_of(k - 1, True), _RUN))
    lower = merged_by_shard(runs, 1, shards, pieces, lambda g: lower_shard(1, g), store_continuations, "few array<long>, n long").collect()
    classes = [sum(r["few"][j] for r in lower) for j in range(4)]
    return NgramModel(
        folder,
        order,
        shards,
        model.words,
        model.tokens,
        documents,
        (_discounts(classes), *reversed(discounts)),
        (classes[0], classes[1], sum(r["n"] for r in lower) - classes[0] - classes[1]),
        types,
    )


def score_documents(docs: DataFrame, model: NgramModel) -> DataFrame:
    """Scores of docs (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score,
    perplexity (10 to the power of -score / n_tokens).

    n_tokens counts the end; base_score is that of single words with 0.1 added to each count, score the
    model's log10 probability of the whole text. A null or empty text is its end alone; a null doc_id
    stays null; rows that repeat are scored each. Very long texts are scored whole. An empty table gives
    an empty result. Columns besides doc_id and text aren't read.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_memo("ngram_lm", forget_hashes)
        def step(ids: list, held: list) -> pd.DataFrame:
            word = model.ids(np.concatenate(held))
            begins = np.cumsum([0, *map(len, held[:-1])])
            counts = model.per_word("counts", "<i8", word)
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            own = model.log10_probabilities(word, begins)
            n = np.array([len(x) for x in held])
            total = np.add.reduceat(own, begins)
            return pd.DataFrame({
                "doc_id": pd.array(ids, "Int64"), "n_tokens": n, "n_known": np.add.reduceat((counts > 0).astype(np.int64), begins), "train_tokens": model.tokens,
                "base_score": np.add.reduceat(base, begins), "score": total, "perplexity": 10 ** np.minimum(-total / n, 300),
            })

        ids, held, n = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids.append(doc_id)
                held.append(token_hashes(text))
                n += len(held[-1])
                if n >= STEP_TOKENS:
                    yield step(ids, held)
                    ids, held, n = [], [], 0
        if held:
            yield step(ids, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
