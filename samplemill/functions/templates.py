"""Chat templates as Column expressions.

A template is text with {{ values }} and {% steps %}: for ... in ..., if, elif, else, set, with names of
fields, literals, comparisons, `and`, `or`, `not`, `in`, `is defined`, `+` and `~`, `a if c else b`, and the
filters trim, upper, lower, length, first, last and default. A loop over an array column becomes one transform:
no Python runs for a row. Rows whose condition of raise_exception(...) holds end the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_WORD = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+~|.,()\[\]<>:%*=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
FILTERS: dict[str, Callable[..., Column]] = {
    "trim": strip,
    "upper": F.upper,
    "lower": F.lower,
    "length": lambda x: F.coalesce(F.size(x), F.lit(0)),
    "first": lambda x: F.get(x, F.lit(0)),
    "last": lambda x: F.get(x, F.size(x) - 1),
    "default": lambda x, other="": F.coalesce(x, other if isinstance(other, Column) else F.lit(other)),
}


class TemplateError(ValueError):
    """A template that isn't understood."""


def said(x) -> Column:
    """A value as text; nothing is empty."""
    if isinstance(x, Column):
        return F.coalesce(x.cast("string"), F.lit(""))
    return F.lit("" if x is None else str(x))


def column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def truth(x):
    """Whether a value counts as true: text that isn't empty, true, or a constant that Python takes for true."""
    if not isinstance(x, Column):
        return bool(x)
    text = F.coalesce(x.cast("string"), F.lit(""))
    return ~text.isin("", "false", "0")


class _Expression:
    """A reader of one expression: constants are computed at once, all else becomes a Column."""

    def __init__(self, text: str, names: dict):
        self.names, self.words, at = names, [], 0
        while text[at:].strip():
            m = _WORD.match(text, at)
            if not m:
                raise TemplateError(f"not understood: {text[at:]!r}")
            quoted = m[2] if m[2] is not None else m[3]
            if m[1] is not None:
                self.words.append(("value", int(m[1])))
            elif quoted is not None:
                self.words.append(("value", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), quoted, flags=re.S)))
            else:
                self.words.append(("word", m[4] or m[5]))
            at = m.end()
        self.at = 0

    def next_is(self, *words: str) -> bool:
        if self.at < len(self.words) and self.words[self.at] in [("word", w) for w in words]:
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.next_is(word):
            raise TemplateError(f"{word!r} is missing")

    def whole(self):
        out = self.choice()
        if self.at < len(self.words):
            raise TemplateError(f"not understood: {self.words[self.at][1]!r}")
        return out

    def choice(self):
        out = self.either()
        if self.next_is("if"):
            condition = truth(self.either())
            other = self.choice() if self.next_is("else") else None
            if isinstance(condition, bool):
                return out if condition else other
            return F.when(condition, column(out)).otherwise(column(other))
        return out

    def either(self):
        out = self.both()
        while self.next_is("or"):
            a, b = truth(out), truth(self.both())
            out = a or b if isinstance(a, bool) and isinstance(b, bool) else column(a) | column(b)
        return out

    def both(self):
        out = self.denied()
        while self.next_is("and"):
            a, b = truth(out), truth(self.denied())
            out = a and b if isinstance(a, bool) and isinstance(b, bool) else column(a) & column(b)
        return out

    def denied(self):
        if self.next_is("not"):
            out = truth(self.denied())
            return (not out) if isinstance(out, bool) else ~out
        return self.compared()

    def compared(self):
        left = self.joined()
        for sign, plain in (("==", lambda a, b: a == b), ("!=", lambda a, b: a != b), ("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b), ("<", lambda a, b: a < b), (">", lambda a, b: a > b)):
            if self.next_is(sign):
                right = self.joined()
                if not isinstance(left, Column) and not isinstance(right, Column):
                    return plain(left, right)
                if sign in ("==", "!="):
                    same = column(left).eqNullSafe(column(right))
                    return same if sign == "==" else ~same
                return F.coalesce(plain(column(left), column(right)), F.lit(False))
        denied = self.next_is("not")
        if self.next_is("in"):
            right = self.joined()
            if not isinstance(left, Column) and not isinstance(right, Column):
                found = left in right
            else:
                found = F.coalesce(F.contains(column(right), column(left)), F.lit(False))
            return found if not denied else (not found) if isinstance(found, bool) else ~found
        if self.next_is("is"):
            denied = self.next_is("not")
            test = self.words[self.at][1] if self.at < len(self.words) else ""
            self.at += 1
            if test not in ("defined", "none"):
                raise TemplateError(f"the test {test!r} isn't known")
            there = left is not None if not isinstance(left, Column) else left.isNotNull()
            out = there if test == "defined" else (not there) if isinstance(there, bool) else ~there
            return out if not denied else (not out) if isinstance(out, bool) else ~out
        return left

    def joined(self):
        out = self.counted()
        while self.at < len(self.words) and self.words[self.at] in (("word", "+"), ("word", "~"), ("word", "-")):
            sign = self.words[self.at][1]
            self.at += 1
            right = self.counted()
            numbers = all(isinstance(x, int) or isinstance(x, _Number) for x in (out, right))
            if sign == "-" or (sign == "+" and numbers):
                a, b = (x.column if isinstance(x, _Number) else x for x in (out, right))
                value = a + b if sign == "+" else a - b
                out = _Number(value) if isinstance(value, Column) else value
            elif not isinstance(out, (Column, _Number)) and not isinstance(right, (Column, _Number)):
                out = f"{'' if out is None else out}{'' if right is None else right}"
            else:
                out = F.concat(*[said(x.column if isinstance(x, _Number) else x) for x in (out, right)])
        return out

    def counted(self):
        out = self.single()
        while self.next_is("%"):
            right = self.single()
            a, b = (x.column if isinstance(x, _Number) else x for x in (out, right))
            out = _Number(a % b) if isinstance(a % b, Column) else a % b
        return out

    def single(self):
        if self.at >= len(self.words):
            raise TemplateError("a value is missing")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "value":
            out = word
        elif word == "(":
            out = self.choice()
            self.need(")")
        elif word in ("true", "True", "false", "False", "none", "None"):
            out = {"t": True, "f": False, "n": None}[word[0].lower()]
        elif word == "raise_exception" and self.next_is("("):
            out = F.raise_error(said(self.choice()))
            self.need(")")
        elif re.match(r"[A-Za-z_]", word):
            out = self.names.get(word)
        else:
            raise TemplateError(f"not understood: {word!r}")
        while True:
            if self.next_is("."):
                name = self.words[self.at][1]
                self.at += 1
                if self.next_is("("):  # x.strip() and the like
                    self.need(")")
                    out = self.filtered({"strip": "trim"}.get(name, name), out, [])
                else:
                    out = self.part(out, name)
            elif self.next_is("["):
                key = self.choice()
                self.need("]")
                out = self.part(out, key)
            elif self.next_is("|"):
                name, given = self.words[self.at][1], []
                self.at += 1
                if self.next_is("("):
                    while not self.next_is(")"):
                        given.append(self.choice())
                        self.next_is(",")
                out = self.filtered(name, out, given)
            else:
                return out

    def part(self, x, key):
        if isinstance(x, dict):
            return x.get(key)
        if x is None:
            return None
        if isinstance(key, str):
            return x.getField(key)
        if isinstance(x, Column):
            return F.get(x, column(key))
        return x[key]

    def filtered(self, name: str, x, given: list):
        if name not in FILTERS:
            raise TemplateError(f"the filter {name!r} isn't known")
        return FILTERS[name](column(x.column if isinstance(x, _Number) else x), *given)


@dataclass(frozen=True)
class _Number:
    """A Column that is a number, so that + adds."""

    column: Column

    def __eq__(self, other):
        return self.column == (other.column if isinstance(other, _Number) else other)

    __hash__ = None


def evaluated(text: str, names: dict):
    out = _Expression(text, names).whole()
    return out.column if isinstance(out, _Number) else out


def parts_of(template: str) -> list[tuple[str, str]]:
    """(text, value or step, contents) one after the other; a minus takes the white space beside it away, and a
    line feed behind a step goes."""
    out, at, cut = [], 0, False
    for m in _PART.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if cut else text
        left, right = next((pair for pair in ((m[1], m[3]), (m[4], m[6]), (m[7], m[8])) if pair[0] is not None), ("", ""))
        out.append(("text", text.rstrip() if left else text))
        if m[2] is not None:
            out.append(("value", m[2]))
        elif m[5] is not None:
            out.append(("step", m[5].strip()))
        at, cut = m.end(), bool(right)
        if m[2] is None and not cut and template[at : at + 1] == "\n":
            at += 1
    rest = template[at:]
    return [p for p in [*out, ("text", rest.lstrip() if cut else rest)] if p != ("text", "")]


class ChatTemplate:
    """template(messages) -> Column: the text of messages (an array of structs, such as role and content).

    names: further values that the template reads, constants or Columns (bos_token, add_generation_prompt).
    Names that nothing gives are undefined: empty as text, and false. No messages give what stands around the
    loops; null messages give null.
    """

    def __init__(self, template: str, **names):
        self.parts, self.given = parts_of(template), names
        self._body(0, {**names, "messages": F.array()}, dry=True)

    def __call__(self, messages: Column) -> Column:
        return F.when(messages.isNotNull(), self._body(0, {**self.given, "messages": messages})[0])

    def _body(self, at: int, names: dict, ends: tuple[str, ...] = (), dry: bool = False) -> tuple[Column, int]:
        """(text of the parts from `at` to a step among ends, place of that step)."""
        out, names = [], dict(names)
        while at < len(self.parts):
            kind, text = self.parts[at]
            if kind == "text":
                out.append(F.lit(text))
            elif kind == "value":
                out.append(said(F.lit("") if dry else evaluated(text, names)))
            else:
                word = text.split(None, 1)[0] if text else ""
                if word in ends:
                    break
                if word == "for":
                    piece, at = self._loop(at, text, names, dry)
                    out.append(piece)
                elif word == "if":
                    piece, at = self._branches(at, names, dry)
                    out.append(piece)
                elif word == "set":
                    m = re.fullmatch(r"set\s+(\w+)\s*=\s*(.*)", text, re.S)
                    if not m:
                        raise TemplateError(f"not understood: {text!r}")
                    names[m[1]] = None if dry else evaluated(m[2], names)
                else:
                    raise TemplateError(f"the step {word!r} isn't known here")
            at += 1
        else:
            if ends:
                raise TemplateError(f"{ends[-1]!r} is missing")
        return F.concat(F.lit(""), *out), at

    def _loop(self, at: int, text: str, names: dict, dry: bool) -> tuple[Column, int]:
        m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.*)", text, re.S)
        if not m:
            raise TemplateError(f"not understood: {text!r}")
        if dry:
            return self._body(at + 1, names, ("endfor",), True)
        items, end = evaluated(m[2], names), at

        def body(item: Column, index: Column) -> Column:
            nonlocal end
            loop = {"index0": _Number(index), "index": _Number(index + 1), "first": index == 0, "last": index == F.size(items) - 1}
            piece, end = self._body(at + 1, {**names, m[1]: item, "loop": loop}, ("endfor",))
            return piece

        return F.array_join(F.transform(items, body), ""), end

    def _branches(self, at: int, names: dict, dry: bool) -> tuple[Column, int]:
        cases, other = [], F.lit("")
        while True:
            word, _, condition = self.parts[at][1].partition(" ")
            piece, end = self._body(at + 1, names, ("elif", "else", "endif"), dry)
            if word == "else":
                other = piece
            else:
                cases.append((F.lit(True) if dry else column(truth(evaluated(condition, names))), piece))
            at = end
            if self.parts[at][1].split(None, 1)[0] == "endif":
                break
        out = None
        for condition, piece in cases:
            out = F.when(condition, piece) if out is None else out.when(condition, piece)
        return out.otherwise(other), at
