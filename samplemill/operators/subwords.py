"""Byte-pair tokenizers from their published files: normalised, split by a pattern, merged by rank.

Pieces of a batch are encoded once each; a worker keeps the ids of common ones.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.stores import read_file

#: How byte-level files split a text where they don't say: words, numbers and other signs with the blank before them, white space.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker keeps, and the longest of them.
MEMO_PIECES, MEMO_CHARS = 200_000, 32
#: Pieces that are split off in one step.
STEP_PIECES = 100_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else one from 256 on in order."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + hidden.index(b)) for b in range(256)]


def merged(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Parts with neighbours joined, the pair of least rank first and everywhere, until none has a rank."""
    while len(parts) > 1:
        rank, first = min(((ranks.get(pair, 1 << 62), pair) for pair in zip(parts, parts[1:], strict=False)), key=lambda x: x[0])
        if rank == 1 << 62:
            return parts
        out, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and (parts[k], parts[k + 1]) == first:
                out.append(parts[k] + parts[k + 1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out
    return parts


class _Loaded:
    """What a file says, ready to encode; one a worker."""

    def __init__(self, path: str):
        import regex

        data = read_file(path)
        if data is None:
            raise FileNotFoundError(path)
        said = json.loads(data)
        model = said["model"]
        if model.get("type") != "BPE":
            raise ValueError("only files of byte-pair encoders are read")
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.unknown = self.vocabulary.get(model.get("unk_token") or "")
        self.special = {t["content"]: t["id"] for t in said.get("added_tokens") or []}
        self.steps = [self._step(n, regex) for n in self._flat(said.get("normalizer"), "normalizers")]
        pattern, self.prefix = BYTE_LEVEL_PATTERN, False
        for part in self._flat(said.get("pre_tokenizer"), "pretokenizers"):
            if part["type"] == "Split":
                if not (part.get("invert") and part["behavior"] == "Removed") or "Regex" not in part["pattern"]:
                    raise ValueError("only pieces that a pattern finds are read")
                pattern = part["pattern"]["Regex"]
            elif part["type"] == "ByteLevel":
                self.prefix = bool(part.get("add_prefix_space"))
            else:
                raise ValueError(f"pieces by {part['type']} aren't read")
        self.pieces = regex.compile(pattern, regex.V0)
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.words = {i: w for w, i in self.vocabulary.items()} | {i: None for i in self.special.values()}
        self.memo: dict[str, list[int]] = {}

    @staticmethod
    def _flat(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    @staticmethod
    def _step(n: dict, regex) -> Callable[[str], str]:
        kind = n["type"]
        if kind in ("NFC", "NFD", "NFKC", "NFKD"):
            return lambda t: unicodedata.normalize(kind, t)
        if kind == "Lowercase":  # letter by letter, whatever stands around it
            return lambda t: t.lower() if t.isascii() else "".join([c.lower() for c in t])
        if kind == "Replace" and "Regex" in n["pattern"]:
            found = regex.compile(n["pattern"]["Regex"])
            return lambda t: found.sub(lambda _: n["content"], t)
        if kind == "Replace":
            return lambda t: t.replace(n["pattern"]["String"], n["content"])
        raise ValueError(f"the normalizer {kind} isn't read")

    def ids(self, piece: str) -> list[int]:
        got = self.memo.get(piece)
        if got is None:
            letters = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
            if letters:
                letters[-1] += self.suffix
            parts = merged(letters, self.ranks)
            got = [i for i in (self.vocabulary.get(p, self.unknown) for p in parts) if i is not None]
            if len(piece) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[piece] = got
        return got

    def tokens(self, text: str, most: int = -1) -> list[int]:
        """The ids of a text, of which no more is split than so many need; special tokens in it count as such."""
        out, at = [], 0
        for m in self.specials.finditer(text) if self.specials else ():
            self._add(out, text[at : m.start()], most)
            out.append(self.special[m[0]])
            at = m.end()
            if 0 <= most <= len(out):
                break
        self._add(out, text[at:], most)
        return out[:most] if most >= 0 else out

    def _add(self, out: list[int], text: str, most: int) -> None:
        if not text or 0 <= most <= len(out):
            return
        for step in self.steps:
            text = step(text)
        if self.prefix and text and not text[0].isspace():
            text = f" {text}"
        found, memo = self.pieces.finditer(text), self.memo
        while some := [m[0] for m in islice(found, most if most > 0 else STEP_PIECES)]:
            for piece in some:
                out += memo.get(piece) or self.ids(piece)
            if 0 <= most <= len(out):
                return

    def text(self, ids: list[int]) -> str:
        letters = "".join(w if not self.suffix else w.removesuffix(self.suffix) + " " * w.endswith(self.suffix) for w in (self.words.get(i) for i in ids) if w)
        data = bytearray()
        for c in letters:
            data += bytes([self.bytes[c]]) if c in self.bytes else c.encode("utf-8")
        return data.decode("utf-8", "replace").strip(" ") if self.suffix else data.decode("utf-8", "replace")


_loaded = cache(_Loaded)


@dataclass(frozen=True)
class BytePairTokenizer:
    """A tokenizer of Tokenize and DecodeTokens from the JSON file of a byte-pair encoder, by path or store URI.

    begin_id and end_id are put around a text and count towards its length. Workers read the file once.
    """

    path: str
    pad_id: int = 0
    begin_id: int | None = None
    end_id: int | None = None

    def encode(self, text: str, most: int = -1) -> list[int]:
        """The ids of a text; at most so many if given, for which no more of it is encoded than needed."""
        begin, end = ([] if i is None else [i] for i in (self.begin_id, self.end_id))
        room = max(0, most - len(begin) - len(end)) if most >= 0 else -1
        return [*begin, *_loaded(self.path).tokens(text, room), *end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without special tokens."""
        return _loaded(self.path).text(ids)

    def ids(self, text: Column, most: int = -1) -> Column:
        tokenizer = self

        @F.pandas_udf("array<int>")
        def encoded(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else tokenizer.encode(t, most) for t in texts], dtype=object)

        return encoded.asNondeterministic()(text)
