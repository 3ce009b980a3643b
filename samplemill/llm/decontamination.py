"""Benchmark decontamination by templates.

Benchmark items and documents are brought to templates: numbers, names and units become typed
placeholders, all other words their lower-cased form without punctuation around. Windows of template
tokens are hashed and joined; the placeholders' values of windows that agree are then held against
each other. A copy whose values were exchanged consistently (one new value for each old one) is the
same question with other parameters; values that contradict each other are a coincidence.

Names are told by their capitals, wherever they stand, so that an item and its copy behind other words
agree; a few function words that open sentences are none. A copy in other case has lost its capitals: so
each text has a second, plain template, in which names are words like others. An item that is too short or
too full of numbers for either ("What is 12 + 7?") has a third one, plain but with signs as words, and is
found as a whole. Windows meet only those of the same kind of template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused, use_memo, written
from .near_dedup import mix

WINDOW_TOKENS = 8
#: Words that aren't placeholders a window needs at least.
MIN_LITERALS = 5
#: Words, slots and signs that an item without a window needs to be looked for as a whole; of them literals.
SHORT_TOKENS, SHORT_LITERALS = 5, 2
#: A document holds an item if so large a share of the item's windows agree, or so many.
MIN_SHARE = 0.5
MIN_WINDOWS = 16
#: Share of an item's slot values that need to map to one value each.
MIN_AGREEMENT = 0.75
#: Bits of the filter of the benchmark's window hashes; more windows only let more through to the join.
FILTER_BITS = 1 << 22
MEMO_WORDS = 1_000_000

# Units and number words that are typed placeholders.
UNITS = {
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "oz",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "degree", "degrees", "mph", "kmh", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "v", "kv",
}
NUMBER_WORDS = {
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen", "half",
}
# Words that open sentences with a capital and aren't names.
OPENERS = {
    "a", "an", "the", "this", "that", "these", "those", "i", "he", "she", "it", "we", "you", "they", "his", "her", "its", "our", "your", "their", "my", "who", "what", "which", "when", "where", "why", "how",
    "if", "is", "are", "was", "were", "do", "does", "did", "has", "have", "had", "can", "could", "will", "would", "should", "in", "on", "at", "by", "for", "from", "of", "to", "with", "after", "before", "during",
    "as", "and", "but", "or", "so", "then", "there", "here", "each", "every", "all", "some", "no", "not", "find", "let", "suppose", "given", "compute", "calculate", "simplify", "solve", "determine", "name",
}
# Signs that are words of a short item's template.
SIGNS = {"+", "-", "−", "*", "/", "=", "<", ">", "%", "^", "×", "÷", "·", "±", "≤", "≥", "≠"}

_U = np.uint64
_EDGES = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*")
_UPPER, _ENDS, _SLOT, _EMPTY, _SIGN = 1, 2, 4, 8, 16
_PLACES = np.random.default_rng(10).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def _code(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


class _Rows(dict):
    """Numbers of words; a word that is looked up and missing is added by add."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, word: str) -> int:
        self.add(word)
        return self[word]


class Vocabulary:
    """What a word is in a template; one a worker, emptied when it has grown to its bound."""

    def __init__(self):
        self.rows = _Rows(self.add)
        self.codes, self.flags = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)

    def add(self, word: str) -> None:
        core = word if word.isalpha() else _EDGES.sub("", word)
        low = core.casefold()
        flags = _ENDS * (word.rstrip("\"')]»”’")[-1:] in {".", "!", "?", ":"}) | _UPPER * (core[:1].isupper() and low not in OPENERS) | _EMPTY * (not core)
        if word in SIGNS:
            low, flags = word, flags | _SIGN
        if not low.isalpha() and _NUMBER.search(low):
            low, flags = _NUMBER.sub("<number>", low), flags | _SLOT
        elif low in NUMBER_WORDS:
            low, flags = "<number>", flags | _SLOT
        elif low in UNITS:
            low, flags = "<unit>", flags | _SLOT
        row = len(self.rows)
        if row == len(self.codes):
            self.codes, self.flags = np.resize(self.codes, 2 * row), np.resize(self.flags, 2 * row)
        self.rows[word], self.codes[row], self.flags[row] = row, _code(low), flags

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) > MEMO_WORDS:
            self.__init__()
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return self.codes[at], self.flags[at]


_vocabulary = Vocabulary()


def forget_words() -> None:
    _vocabulary.__init__()


_NAME = _U(_code("<name>"))


def templates(text: str | None, short: bool = False) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[str]]:
    """The templates of a text, each (codes, whether a slot, the word each stands at), and its words: the one
    with names, the plain one, and with short the plain one with signs.

    A capitalised word is a name, unless it is one of OPENERS; names that follow one another in a sentence
    are one name. Words of punctuation alone are left out. In the plain template names are words; where
    it is the same as the first, both are the same object.
    """
    words = text.split() if text else []
    codes, flags = _vocabulary.of(words)
    slot, name = flags & _SLOT != 0, flags & (_UPPER | _SLOT) == _UPPER

    at = np.flatnonzero(flags & _EMPTY == 0)
    plain = codes[at], slot[at], at
    found = [plain, plain]
    if name.any():
        own, stays = name[at], np.ones(len(at), bool)
        stays[1:] = ~(own[1:] & own[:-1] & (flags[at[:-1]] & _ENDS == 0))
        found[0] = np.where(own, _NAME, codes[at])[stays], (slot[at] | own)[stays], at[stays]
    if short:
        at = np.flatnonzero(flags & (_EMPTY | _SIGN) != _EMPTY)
        found.append((codes[at], slot[at], at))
    return found, words


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(codes, whether a slot, the word each stands at, words) of a text's template."""
    found, words = templates(text)
    return *found[0], words


def window_hashes(codes: np.ndarray, slot: np.ndarray, size: int, min_literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows with enough literals."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # codes are hashes already: their sum, each times an odd number of its place, is mixed once
    total, term = np.full(n, size, np.uint64), np.empty(n, np.uint64)
    for j in range(size):
        total += np.multiply(codes[j : j + n], _PLACES[j], out=term)
    total = mix(total)
    literals = np.cumsum(np.concatenate([[0], ~slot]))
    good = np.flatnonzero(literals[size:] - literals[:-size] >= min_literals)
    return good, total[good]


def _slot_values(slot: np.ndarray, at: np.ndarray, words: list[str], pos: int, size: int) -> list[str]:
    return [_EDGES.sub("", words[k]) for k in at[pos : pos + size][slot[pos : pos + size]]]


#: kind: 0 with names, 1 plain, 2 with signs.
_WINDOW_SCHEMA = "row_id long, kind int, window_hash long, pos long, size int, n_windows long, slots array<string>"
#: Keeps the hashes of the kinds apart.
_KINDS = [_U(0), _U(_code("<plain>")), _U(_code("<short>"))]


def _item_windows(text: str | None, size: int, min_literals: int) -> Iterator[tuple]:
    """(kind, hashes, positions, size, template) of an item; shorter ones are one window, and one that has no
    window otherwise is a window of the third kind."""
    found, words = templates(text, short=True)
    some = False
    for kind, (codes, slot, at) in enumerate(found[:2]):
        own = min(size, len(codes))
        pos, hashes = window_hashes(codes, slot, own, min_literals)
        some |= len(pos) > 0
        yield kind, pos, hashes, own, slot, at, words
    codes, slot, at = found[2]
    if not some and len(codes) >= SHORT_TOKENS and slot.any():
        yield 2, *window_hashes(codes, slot, len(codes), SHORT_LITERALS), len(codes), slot, at, words


def _document_windows(text: str | None, sizes: list[tuple[int, int]], min_literals: int) -> Iterator[tuple]:
    """The same for a document, with windows of each (kind, size)."""
    found, words = templates(text, short=any(kind == 2 for kind, _ in sizes))
    same: dict[int, tuple] = {}
    for kind, size in sizes:
        codes, slot, at = found[kind]
        if size > len(codes):
            continue
        if kind == 1 and found[1] is found[0] and size in same:
            pos, hashes = same[size]
        else:
            pos, hashes = window_hashes(codes, slot, size, SHORT_LITERALS if kind == 2 else min_literals)
        if kind == 0:
            same[size] = pos, hashes
        yield kind, pos, hashes, size, slot, at, words


def _window_rows(rows: DataFrame, windows, keep: np.ndarray | None) -> DataFrame:
    """Windows of rows (row_id, text) by windows(text); keep: bitmap of the hashes to keep."""
    given = rows.sparkSession.sparkContext.broadcast(keep)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use_memo("decontamination", forget_words)
        bits = given.value
        for batch in batches:
            out = []
            for row_id, text in zip(batch["row_id"], batch["text"], strict=True):
                for kind, pos, hashes, size, slot, at, words in windows(text):
                    n, hashes = len(pos), hashes ^ _KINDS[kind]
                    if bits is not None:
                        where = (hashes & _U(FILTER_BITS - 1)).astype(np.int64)
                        hit = np.flatnonzero(bits[where >> 3] >> (where & 7) & 1)
                        pos, hashes = pos[hit], hashes[hit]
                    for p, h in zip(pos.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        values = _slot_values(slot, at, words, p, size)
                        out.append((row_id, kind, h, p, size, n, [v.casefold() for v in values] if kind else values))
            yield pd.DataFrame(out, columns=["row_id", "kind", "window_hash", "pos", "size", "n_windows", "slots"])

    return rows.mapInPandas(find, _WINDOW_SCHEMA)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window_tokens: int = WINDOW_TOKENS,
    min_literals: int = MIN_LITERALS,
    min_share: float = MIN_SHARE,
    min_windows: int = MIN_WINDOWS,
    min_agreement: float = MIN_AGREEMENT,
) -> DataFrame:
    """The benchmark items (item_id, text) that documents (doc_id, text) hold.

    Returns a row for each document and item: doc_id, item_id, matched_windows (different windows of
    the item that agree), item_windows, share, first_token and last_token (template positions in the
    document; in the plain template, or the one with signs, if only that finds the item), and reparameterised (whether a slot
    has another value).

    Case doesn't matter for copies word by word, nor for numbers and units. A copy in other case whose names
    were exchanged as well loses each window that holds one.

    Items shorter than a window are one window. An item none of whose windows has min_literals literals is
    one window with its signs, if it has SHORT_TOKENS words, slots and signs, a slot, and SHORT_LITERALS
    that are none; items with less than that ("Yes.") say nothing and are never found. Null or empty texts hold nothing. A null doc_id or item_id stays null.
    Rows that repeat a doc_id or an item_id are taken together. Empty tables give an empty result.
    Other columns aren't read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    wanted = _window_rows(items, lambda text: _item_windows(text, window_tokens, min_literals), None).withColumnsRenamed({"row_id": "item_id", "pos": "item_pos", "n_windows": "item_windows", "slots": "item_slots"})
    wanted = written(wanted, "benchmark-windows")
    # window lengths in use and a bitmap of fixed size: all that is sent to the tasks
    sizes = sorted({(0, window_tokens), (1, window_tokens), *((r["kind"], r["size"]) for r in wanted.select("kind", "size").distinct().collect())})
    place = F.col("window_hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    marked = wanted.select(place.alias("place")).groupBy(F.expr("place div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(place % 8 as int)))").alias("bits"))
    keep = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marked.collect():  # at most FILTER_BITS / 8 rows
        keep[r["byte"]] = r["bits"]
    rows = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    near = _window_rows(rows, lambda text: _document_windows(text, sizes, min_literals), keep).drop("n_windows", "size", "kind").withColumnRenamed("row_id", "doc_id")
    joined = near.join(wanted, "window_hash").withColumn("shift", F.col("pos") - F.col("item_pos"))
    # each alignment of the two for itself, then the consistent ones together
    values = F.arrays_zip("item_slots", "slots")
    aligned = joined.groupBy("doc_id", "item_id", "kind", "shift", "item_windows").agg(F.array_distinct(F.flatten(F.collect_set(values))).alias("values"), F.collect_set("item_pos").alias("places"), F.min("pos").alias("first_token"), F.max("pos").alias("last_token"))
    old = F.array_distinct(F.transform("values", lambda v: v["item_slots"]))
    clear = F.filter(old, lambda o: F.size(F.filter("values", lambda v: v["item_slots"] == o)) == 1)
    consistent = aligned.filter((F.size(old) == 0) | (F.size(clear) >= F.lit(min_agreement) * F.size(old)))
    changed = F.exists("values", lambda v: v["item_slots"] != v["slots"])
    places = consistent.select("doc_id", "item_id", "kind", "item_windows", "first_token", "last_token", changed.alias("changed"), F.explode("places").alias("place"))
    found = places.groupBy("doc_id", "item_id", "kind").agg(F.countDistinct("place").alias("matched_windows"), F.max("item_windows").alias("item_windows"), F.min("first_token").alias("first_token"), F.max("last_token").alias("last_token"), F.min("changed").alias("reparameterised"))
    found = found.withColumn("share", F.col("matched_windows") / F.col("item_windows"))
    held = found.filter((F.col("share") >= min_share) | (F.col("matched_windows") >= min_windows))
    columns = ["matched_windows", "item_windows", "share", "first_token", "last_token", "reparameterised"]
    # what several templates find is told by the one with names, if it is among them
    once = held.groupBy("doc_id", "item_id").agg(F.min_by(F.struct(*columns), "kind").alias("found"))
    return once.select("doc_id", "item_id", *[F.col("found")[c].alias(c) for c in columns])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay.

    Each row is judged by its own text: rows are told apart by a hash of doc_id and text.
    """
    key = F.xxhash64("doc_id", F.col("text").cast("string"))
    held = find_contamination(docs.select(key.alias("doc_id"), "text"), benchmark, **parameters).select(F.col("doc_id").alias("_held")).distinct()
    name, other = unused(docs, "_key", "_held")
    own, held = docs.withColumn(name, key), held.withColumnRenamed("_held", other)
    return own.join(held, F.col(name) == F.col(other), "left_anti").drop(name)
