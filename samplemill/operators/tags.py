"""Captions as delimiter-separated tags. Shuffle and drop join with the delimiter and a blank and leave
empty tags out; capitalisation joins with the bare delimiter and keeps them."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stores import read_file
from ..plans.stage import ColumnStage, Context, resolve

FULL, RANDOM, RANDOM_WEIGHTED = "FULL", "RANDOM", "RANDOM WEIGHTED"
NONE, WHITELIST, BLACKLIST = "NONE", "WHITELIST", "BLACKLIST"
_PATTERN_SIGNS = re.compile(r"[.^$*+?{}\[\]|()\\]")


@dataclass
class ReplaceText(ColumnStage):
    """Every occurrence of a text as it stands. An empty old text is rejected."""

    text_in: str
    text_out: str
    old_text: str
    new_text: str

    def __post_init__(self):
        if not self.old_text:
            raise ValueError("old_text is empty")

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        return {self.text_out: F.replace(resolve(df, self.text_in), F.lit(self.old_text), F.lit(self.new_text))}


def flag(df: DataFrame, name: str | None) -> Column:
    return F.lit(True) if name is None else F.coalesce(resolve(df, name).cast("boolean"), F.lit(False))


@dataclass
class ShuffleTags(ColumnStage):
    """Tags after the first keep_tags_count in random order."""

    text_in: str
    enabled_in: str
    delimiter_in: str
    keep_tags_count_in: str
    text_out: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        text, delimiter = resolve(df, self.text_in), resolve(df, self.delimiter_in)

        def shuffled(tags: Column) -> Column:
            head, rest = tx.head_and_rest(tags, resolve(df, self.keep_tags_count_in))
            keyed = F.array_sort(F.transform(rest, lambda t, i: F.struct(self.random(ctx, i).alias("u"), i.alias("i"), t.alias("t"))))
            return F.concat(head, F.transform(keyed, lambda x: x["t"]))

        mixed = tx.join_with(tx.bound(tx.stripped_tags(text, delimiter), shuffled), F.concat(delimiter, F.lit(" ")))
        return {self.text_out: F.when(flag(df, self.enabled_in), mixed).otherwise(text)}


def special_tags(given: str, delimiter: str) -> list[str]:
    """The special tags of a .txt (one a line), a .csv (first column), by path or store URI, or a delimited text."""
    if given.endswith((".txt", ".csv")):
        data = read_file(given)
        if data is None:
            raise FileNotFoundError(given)
        text = data.decode("utf-8")
        if given.endswith(".txt"):
            return [line.rstrip("\n") for line in io.StringIO(text, newline=None)]
        return [row[0] for row in csv.reader(io.StringIO(text, newline="")) if row]
    return [t.strip() for t in given.split(delimiter)]


def tag_patterns(tags: list[str]) -> tuple[list[str], list[str]]:
    """(tags to compare, patterns to match whole) of special tags; what doesn't compile is compared."""
    plain, patterns = [], []
    for t in tags:
        try:
            (patterns if _PATTERN_SIGNS.search(t) and re.compile(t) else plain).append(t)
        except re.error:
            plain.append(t)
    return plain, patterns


@dataclass
class DropTags(ColumnStage):
    """Drop tags after the first keep_tags_count, all at once or each by a draw of its own.

    special_tags: a list, or a text: the name of a .txt or .csv file, or tags with the delimiter between
    (special_delimiter). special_tags_in: a column with such a text in each row; the few files that its
    values may name are given as special_files, which are read while the plan is built.
    WHITELIST tags always stay; with BLACKLIST all others do. RANDOM WEIGHTED drops later tags more.
    """

    text_in: str
    enabled_in: str
    probability_in: str
    dropout_mode_in: str
    special_tag_mode_in: str
    delimiter_in: str
    keep_tags_count_in: str
    text_out: str
    special_tags: list[str] | str | None = None
    special_tags_in: str | None = None
    regex_enabled: bool = False
    special_delimiter: str = ","
    special_files: list[str] = field(default_factory=list)

    def _listed(self, df: DataFrame, delimiter: Column):
        if self.special_tags_in is not None:
            named = resolve(df, self.special_tags_in)
            given = F.coalesce(F.transform(tx.split_plain(named, delimiter), tx.strip), F.array().cast("array<string>"))
            for name in self.special_files:
                content = F.array(*[F.lit(t) for t in special_tags(name, self.special_delimiter)]).cast("array<string>")
                given = F.when(named == name, content).otherwise(given)
            unread = (named.endswith(".txt") | named.endswith(".csv")) & ~named.isin(self.special_files)
            given = F.when(unread, F.raise_error(F.concat(F.lit("not among special_files: "), named)).cast("array<string>")).otherwise(given)
            if not self.regex_enabled:
                return lambda t: F.array_contains(given, t)
            whole = lambda p: F.concat(F.lit("^(?:"), p, F.lit(")$"))
            return lambda t: F.array_contains(given, t) | F.exists(given, lambda p: F.rlike(t, whole(p)) | F.rlike(F.btrim(t, F.lit("()")), whole(p)))
        tags = special_tags(self.special_tags, self.special_delimiter) if isinstance(self.special_tags, str) else self.special_tags or []
        plain, patterns = tag_patterns(tags) if self.regex_enabled else (tags, [])

        def listed(t: Column) -> Column:
            out = t.isin(*plain) if plain else F.lit(False)
            for p in patterns:
                out = out | t.rlike(f"^(?:{p})$") | F.btrim(t, F.lit("()")).rlike(f"^(?:{p})$")
            return out

        return listed

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        text, delimiter = resolve(df, self.text_in), resolve(df, self.delimiter_in)
        p, mode, special = resolve(df, self.probability_in).cast("double"), resolve(df, self.dropout_mode_in), resolve(df, self.special_tag_mode_in)
        listed = self._listed(df, delimiter)
        spared = lambda t: F.when(special == WHITELIST, listed(t)).when(special == BLACKLIST, ~listed(t)).otherwise(F.lit(False))

        def left(rest: Column, n: Column) -> Column:
            weight = lambda i: F.when(mode == RANDOM_WEIGHTED, p * (i + 1) / n).otherwise(p)
            drawn = F.filter(rest, lambda t, i: (self.random(ctx, i) > weight(i)) | spared(t))
            whole = F.when(self.random(ctx, 0) < p, F.filter(rest, spared)).otherwise(rest)
            return F.when(mode == FULL, whole).when(F.startswith(mode, F.lit(RANDOM)), drawn).otherwise(rest)

        def dropped(tags: Column) -> Column:
            head, rest = tx.head_and_rest(tags, resolve(df, self.keep_tags_count_in))
            some = tx.bound(F.struct(rest.alias("tags"), F.size(rest).alias("n")), lambda r: left(r["tags"], r["n"]))
            return F.concat(head, some)

        out = tx.join_with(tx.bound(tx.stripped_tags(text, delimiter), dropped), F.concat(delimiter, F.lit(" ")))
        return {self.text_out: F.when(flag(df, self.enabled_in) & (p > 0), out).otherwise(text)}


@dataclass
class CapitalizeTags(ColumnStage):
    """Change the case of tags by draws; the modes are a comma-separated list to draw from:
    capslock, title, first, random (each letter), anything else leaves the tag."""

    text_in: str
    enabled_in: str
    probability_in: str
    capitalize_mode_in: str
    delimiter_in: str
    convert_lowercase_in: str
    text_out: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        given, delimiter = resolve(df, self.text_in), resolve(df, self.delimiter_in)
        text = F.when(flag(df, self.convert_lowercase_in), F.lower(given)).otherwise(given)
        p = resolve(df, self.probability_in).cast("double")
        modes = F.transform(F.split(resolve(df, self.capitalize_mode_in), ","), tx.strip)
        draw = lambda i, what: self.random(ctx, F.concat_ws(".", i.cast("string"), F.lit(what) if isinstance(what, str) else what))

        def letters(t: Column, i: Column) -> Column:
            each = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c, k: F.when(draw(i, k.cast("string")) < 0.5, F.upper(c)).otherwise(F.lower(c)))
            return F.array_join(each, "")

        def changed(t: Column, i: Column) -> Column:
            mode = F.element_at(modes, (F.floor(draw(i, "m") * F.size(modes)) + 1).cast("int"))
            new = F.when(mode == "capslock", F.upper(t)).when(mode == "title", tx.capwords(t)).when(mode == "first", tx.capitalize(t)).when(mode == "random", letters(t, i)).otherwise(t)
            return F.when(draw(i, "p") < p, new).otherwise(t)

        out = tx.join_with(F.transform(F.transform(tx.split_plain(text, delimiter), tx.strip), changed), delimiter)
        return {self.text_out: F.when(flag(df, self.enabled_in) & (p > 0), out).otherwise(text)}
