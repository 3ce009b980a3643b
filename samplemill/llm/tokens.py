"""Whole texts to token ids with the tokenizers library, with a memo of words.

A public tokenizer file splits a text into pieces by a pattern and encodes each piece alone.
No piece of the byte-level pattern reaches over a single blank between two characters that are
not white space (the blank opens the next piece), a single line feed between two such is a piece of
its own, and no piece of the word-level pattern holds white space at all. In both a run of letters
and the punctuation behind it are different pieces. A text cut there gives the same ids as the whole
text, so each distinct part is encoded once and kept in a memo. Texts in which special tokens may
stand, or white space beside white space, are cut with more care or go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import cache
from itertools import filterfalse

import numpy as np

from .common import use_memo

#: Chunks that one worker keeps; a full memo is emptied, which costs time but changes no id.
MEMO_CHUNKS = 1_200_000
#: Longer chunks are encoded each time.
MEMO_CHARS = 48

#: Missing parts that are encoded in one call, joined as a text they could have stood in.
JOINED_PARTS = 512
#: The same for parts that need no normalizer.
JOINED_LETTERS = 128

#: White space beside white space, or at an end: a plain split would cut at the wrong places.
_RAGGED = re.compile(r"\s\s|\A\s|\s\Z")
_BYTE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters that lower-casing and composition leave single letters.
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Letters and then perhaps punctuation, which the word-level pattern takes for two pieces (' may open a piece with letters).
_PUNCTUATED = re.compile(rf"({_LETTERS.pattern})([!-&(-/:-@\[-`{{-~]*)")
#: Characters that Python takes for white space and Unicode's property White_Space doesn't hold.
_NOT_WHITE_SPACE = "\x1c\x1d\x1e\x1f"
#: White space but for blanks and line feeds, and those two beside one another.
_RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  ", " \n", "\n ", "\n\n"]
_MARKS = frozenset(".,;:!?")


def _is_ragged(text: str) -> bool:
    """Whether _RAGGED is found in text; searches for single strings, much faster than a pattern, rule it out for most."""
    if not (text[0].isspace() or text[-1].isspace() or any(s in text for s in _RARE_SPACE)):
        return False
    return _RAGGED.search(text) is not None


def _of_letters(path: str):
    """The file's tokenizer for small letters between blanks, which its normalizers leave alone and its pattern keeps
    whole: without both. None for a file of another kind."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    steps, pieces = (found.get("normalizer") or {}).get("normalizers", []), (found.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = all(x["type"] in ("NFC", "Lowercase") or (x["type"], x.get("pattern")) == ("Replace", {"Regex": r"\s+"}) for x in steps)
    if not steps or not plain or [x["type"] for x in pieces] != ["Split", "ByteLevel"] or pieces[1]["use_regex"] or r"[\p{L}]+" not in pieces[0]["pattern"].get("Regex", ""):
        return None
    blanks = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
    return Tokenizer.from_str(json.dumps(found | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blanks, pieces[1]]}}))


class ChunkEncoder:
    """encode(text) -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level tokenizer without normalizer keeps blanks as part of the next piece
        self.keeps_blanks = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        if self.keeps_blanks:
            (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        else:
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
            upper = [c for c in map(chr, range(256)) if _LETTERS.fullmatch(c) and c.lower() != c]
            #: whether upper-case letters have the ids of lower-case ones, so that a word is encoded in one case only
            self.lowers = self._whole([f"a{c}b" for c in upper]) == self._whole([f"a{c.lower()}b" for c in upper])
            self.letters = _of_letters(path) if self.lowers else None
        #: ids of a word, with the blank before it (if blanks are kept) unless it starts with a line feed
        self.memo: dict[str, bytes] = {}
        #: ids of the words that open a text
        self.first: dict[str, bytes] = {}
        self.marks = dict(zip(sorted(_MARKS), self._whole(sorted(_MARKS)), strict=True))
        self.memo_chunks = memo_chunks

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _cut(self, some: list[str], ids: np.ndarray, begins: np.ndarray, skip: list[int]) -> dict[str, bytes]:
        if len(begins) != len(some):  # never seen; the library decides alone then
            return dict(zip(some, self._whole([f" {p}" if self.keeps_blanks and p[0] != "\n" else p for p in some]), strict=True))
        data, at = ids.tobytes(), (4 * begins).tolist() + [4 * len(ids)]
        return {p: data[at[k] + skip[k] : at[k + 1]] for k, p in enumerate(some)}

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts; those of a kept blank before them are among these."""
        out, tokenizer, joined = {}, self.tokenizer, JOINED_PARTS
        if not self.keeps_blanks and self.letters:
            tokenizer, joined = self.letters, JOINED_LETTERS
        for at in range(0, len(parts), joined):
            some = parts[at : at + joined]
            if self.keeps_blanks:  # each part follows a line feed, which is a piece of its own
                text = "".join([p if p[0] == "\n" else f"\n {p}" for p in some])
                ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                out |= self._cut(some, ids, np.flatnonzero(ids == self.feed), [0 if p[0] == "\n" else 4 for p in some])
            else:  # parts of letters alone, each a piece that ends with a token marked so
                ids = np.asarray(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                out |= self._cut(some, ids, np.concatenate([[0], ends[:-1]]), [0] * len(some))
        return out

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of words that the memo doesn't have."""
        if not self.keeps_blanks:
            return self._learn_pieces(missing)
        memo, known, parts, composed = self.memo, {}, set(), []
        for word in missing:
            core = word[:-1]
            if word[-1] in _MARKS and _LETTERS.fullmatch(core):
                composed.append(word)
                if core not in memo:
                    parts.add(core)
            else:
                parts.add(word)
        known |= self._encode_parts(list(parts))
        for word in composed:
            core = word[:-1]
            known[word] = (memo[core] if core in memo else known[core]) + self.marks[word[-1]]
        return known

    def _learn_pieces(self, missing: set[str]) -> dict[str, bytes]:
        """The same without kept blanks: letters in one case, and punctuation behind them, are each encoded once."""
        memo, parts, other, composed, match = self.memo, set(), set(), [], _PUNCTUATED.fullmatch
        for word in missing:
            if not (found := match(word)):
                other.add(word)
                continue
            core, tail = found.groups()
            if self.lowers:
                core = core.lower()
            if core not in memo:
                parts.add(core)
            if tail and tail not in memo:
                other.add(tail)
            if core != word:
                composed.append((word, core, tail))
        known, names = self._encode_parts(list(parts)), list(other)
        known |= zip(names, self._whole(names), strict=True)
        for word, core, tail in composed:
            ids = known[core] if core in known else memo[core]
            if tail:
                ids += known[tail] if tail in known else memo[tail]
            known[word] = ids
        return known

    def _words(self, words: list[str]) -> bytes:
        """Ids of all words; what is done for each word runs inside filterfalse, map and join."""
        memo, long = self.memo, []
        missing = set(filterfalse(memo.__contains__, words))
        if missing:
            if len(memo) > self.memo_chunks:
                memo.clear()
                missing = set(words)
            learned = self._learn(missing)
            memo.update(learned)
            long = [w for w in learned if len(w) > MEMO_CHARS]
        out = b"".join(map(memo.__getitem__, words))
        for w in long:
            del memo[w]
        return out

    def _first(self, first: str) -> bytes:
        if first not in self.first:
            if len(self.first) > self.memo_chunks:
                self.first.clear()
            self.first[first] = self._whole([first])[0]
        return self.first[first]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self._whole([text])[0]
        if not self.keeps_blanks:
            if any(c in text for c in _NOT_WHITE_SPACE):
                return self._whole([text])[0]
            return self._words(text.split())
        if _is_ragged(text):
            first, *rest = _BYTE_CUT.split(text)
            if rest and _RAGGED.search(rest[-1]):
                last = [f" {rest.pop()}"]
                ends = self._whole(last)
            else:
                ends = []
            if any("\n" in w for w in rest):
                return b"".join(self._whole([first, *[f" {w}" for w in rest]]) + ends)
            return b"".join([*self._whole([first]), self._words(rest), *ends])
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._first(first) + self._words(rest)

    def forget(self) -> None:
        self.memo.clear()
        self.first.clear()

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


@cache
def _kept_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process, kept over its tasks; another operator's use empties its memo."""
    found = _kept_encoder(path)
    use_memo(path, found.forget)
    return found


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
