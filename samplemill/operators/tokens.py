"""Token ids and masks. Any object with `encode` and `decode` is a tokenizer (subwords.BytePairTokenizer reads
published files); without one, words are hashed to ids natively."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.stage import ColumnStage, Context, Stage, resolve


@dataclass(frozen=True)
class HashVocabulary:
    """Ids of lower-cased words by md5; 0 is padding, 1 unknown, ids start at 2."""

    size: int = 30_000
    pad_id: int = 0

    def ids(self, text: Column, most: int = -1) -> Column:
        """Ids of the words; only the first `most` are split off and hashed, if given."""
        # one piece more for white space at the start, and one for what is left unsplit
        words = F.filter(F.split(F.lower(text), r"\s+", most + 2 if most >= 0 else -1), lambda w: w != "")
        return F.transform(F.slice(words, 1, most) if most >= 0 else words, self.id_of)

    def id_of(self, word: Column) -> Column:
        return (F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(self.size)) + 2).cast("int")


def padded(ids: Column, length: int, pad: Column | int = 0) -> Column:
    """Cut or right-padded to length."""
    filler = pad if isinstance(pad, Column) else F.lit(pad)
    return F.slice(F.concat(ids, F.array_repeat(filler, F.greatest(F.lit(length) - F.size(ids), F.lit(0)))), 1, length)


@dataclass
class Tokenize(ColumnStage):
    """Texts to padded ids and their mask.

    format_text: a pattern with {} for the text, for which more tokens are allowed; chat_template: a
    Column function; suffix_text: tokens put unpadded after the padding; expand_mask: so many zeros of
    the mask become ones, from the left.
    """

    in_name: str
    tokens_out: str
    mask_out: str
    tokenizer: object
    max_token_length: int
    format_text: str | None = None
    additional_format_text_tokens: int = 0
    suffix_text: str | None = None
    chat_template: Callable | None = None
    expand_mask: int = 0

    def _ids(self, text: Column, most: int = -1) -> Column:
        if hasattr(self.tokenizer, "ids"):  # knows columns
            return self.tokenizer.ids(text, most)
        tokenizer = self.tokenizer

        @F.pandas_udf("array<int>")
        def encoded(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else list(tokenizer.encode(t)))

        return encoded.asNondeterministic()(text)

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        text, length = resolve(df, self.in_name), self.max_token_length
        if self.format_text is not None:
            text, length = F.replace(F.lit(self.format_text), F.lit("{}"), text), length + self.additional_format_text_tokens
        if self.chat_template is not None:
            text = self.chat_template(text)
        ids = self._ids(text, length)
        tokens = tx.bound(ids, lambda x: padded(x, length, getattr(self.tokenizer, "pad_id", 0)))
        mask = tx.bound(ids, lambda x: padded(F.transform(x, lambda _: F.lit(1)), length))
        if self.suffix_text is not None:
            more = self._ids(F.lit(self.suffix_text))
            tokens, mask = F.concat(tokens, more), F.concat(mask, F.transform(more, lambda _: F.lit(1)))
        if self.expand_mask:
            zeros = lambda given: F.slice(F.filter(F.transform(given, lambda m, i: F.when(m == 0, i).otherwise(-1)), lambda i: i >= 0), 1, self.expand_mask)
            end = lambda given: F.coalesce(F.array_max(zeros(given)), F.lit(-1))
            widened = lambda b: F.transform(b["mask"], lambda m, i: F.when(i <= b["end"], F.lit(1)).otherwise(m))
            mask = tx.bound(mask, lambda given: tx.bound(F.struct(given.alias("mask"), end(given).alias("end")), widened))
        return {self.tokens_out: tokens, self.mask_out: mask}


@dataclass
class DecodeTokens(Stage):
    """Ids to text by a vocabulary table (id, word): exploded, joined, put together in order. Special
    ids (below first_id) are skipped; an id without word is left out."""

    in_name: str
    out_name: str
    vocabulary: DataFrame | None = None
    first_id: int = 2
    tokenizer: object = None

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        ids = resolve(df, self.in_name)
        if self.tokenizer is not None:
            tokenizer = self.tokenizer

            @F.pandas_udf("string")
            def decoded(values: pd.Series) -> pd.Series:
                return values.map(lambda x: None if x is None else tokenizer.decode(list(x)))

            return df.withColumn(self.out_name, decoded.asNondeterministic()(ids))
        one = self.vocabulary.groupBy("id").agg(F.min("word").alias("word"))
        each = df.select("variation", "idx", F.posexplode(ids).alias("at", "id")).filter(F.col("id") >= self.first_id).join(one, "id")
        texts = each.groupBy("variation", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("_text"))
        return df.join(texts, ["variation", "idx"], "left").withColumn(self.out_name, F.coalesce("_text", F.lit(""))).drop("_text")


@dataclass
class PruneMaskedTokens(ColumnStage):
    """Only positions whose mask isn't 0, in tokens, mask and hidden state alike."""

    tokens: str
    tokens_mask: str
    hidden_state: str | None = None

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        mask = resolve(df, self.tokens_mask)
        names = [n for n in (self.tokens, self.tokens_mask, self.hidden_state) if n]
        return {n: F.filter(resolve(df, n), lambda x, i: F.get(mask, i) != 0) for n in names}


@dataclass
class PadMaskedTokens(ColumnStage):
    """Right-padded with zeros (hidden states with zero vectors), or cut, to max_length."""

    tokens: str
    tokens_mask: str
    hidden_state: str | None
    max_length: int

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        out = {n: padded(resolve(df, n), self.max_length) for n in (self.tokens, self.tokens_mask)}
        if self.hidden_state:
            state = resolve(df, self.hidden_state)
            zero = F.transform(F.get(state, F.lit(0)), lambda x: x * 0)
            out[self.hidden_state] = padded(state, self.max_length, zero)
        return out
