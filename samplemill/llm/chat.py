"""Chat transcripts to canonical turns: roles from a hidden Markov model over line features.

A transcript is lines. The hidden states are (role, whether a turn opens); a line shows a speaker marker
("User:", "### Assistant", "<|system|>", or none), how long it is and how it ends. All probabilities are
counts over labelled lines. Viterbi finds the best roles; markers are cut off and each turn is rendered.

Lines are dealt to blocks of their order (transcript, turn, part, line) and sorted there, so that a task
decodes many transcripts in one pass, and a transcript with most of all lines spreads over many blocks.
Only a transcript that goes on in a further block needs more: the best-path scores of its part in a
block, for each pair of states before and at its end, form a small matrix; matrices multiply along the
transcript (max and plus), which gives the states at the parts' ends exactly. A block border is inside one
transcript at most, so there are fewer such transcripts than blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.index import with_key_block

ROLES = ("system", "user", "assistant")
#: Role, and whether the line opens a turn; state = 2 * role + (not opening).
STATES = 2 * len(ROLES)

# The speaker words of each role.
SPEAKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "gpt"),
}
_CLASS = {word: k + 1 for k, role in enumerate(ROLES) for word in SPEAKERS[role]}
_MARKER = re.compile(r"^\s*(?:#{1,6}\s*(\w+)\s*:?\s*|<\|(\w+)\|>\s*|\[(\w+)\]\s*:?\s*|\**(\w+)\**\s*:\s+|\**(\w+)\**\s*:$)")
#: Values of each feature: marker (none, a role's, another's), ending, length.
SIZES = (len(ROLES) + 2, 4, 8)


def features(line: str | None) -> tuple[int, int, int]:
    """(marker, ending, length class) of a line; null counts as empty."""
    line = line or ""
    found = _MARKER.match(line)
    marker = _CLASS.get(next(g for g in found.groups() if g).lower(), len(ROLES) + 1) if found else 0
    text = line[found.end() :].rstrip() if found else line.rstrip()
    ending = 0 if not text else 1 if text[-1] in "?¿" else 2 if text[-1] in ".!…" else 3
    return marker, ending, min(SIZES[2] - 1, len(text.split()).bit_length())


def without_marker(line: str | None, opens: bool) -> str:
    """The line without a known speaker's marker, if it opens a turn."""
    line = line or ""
    found = _MARKER.match(line) if opens else None
    return line[found.end() :] if found and next(g for g in found.groups() if g).lower() in _CLASS else line


@dataclass(frozen=True)
class TurnModel:
    """Log probabilities: start (STATES), step (STATES x STATES), and one table for each feature."""

    start: np.ndarray
    step: np.ndarray
    shows: tuple[np.ndarray, ...]

    def emissions(self, lines: list[str | None]) -> np.ndarray:
        found = np.array([features(x) for x in lines], np.int64).reshape(-1, len(SIZES))
        return sum(table[:, found[:, k]].T for k, table in enumerate(self.shows))

    def _first(self, shown: np.ndarray, opening: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.where(opening[:, None], self.start[None], self.step[before]) + shown

    def matrices(self, shown: np.ndarray, parts: "Parts", opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part, for each state before it (any, if it opens a transcript) and each at its end: the
        score of the best path, and how many lines of that path open a turn."""
        opens = (np.arange(STATES) % 2 == 0).astype(np.int64)
        before = np.arange(STATES)
        best = np.stack([self._first(shown[parts.begins], opening, np.full(len(opening), b)) for b in before], axis=1)
        turns = np.broadcast_to(opens, best.shape).copy()
        for a, rows in parts.steps():
            through = best[:a, :, :, None] + self.step
            back = through.argmax(axis=2)
            best[:a] = through.max(axis=2) + shown[rows][:, None, :]
            turns[:a] = np.take_along_axis(turns[:a], back, axis=2) + opens
        return best, turns

    def paths(self, shown: np.ndarray, parts: "Parts", opening: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The best state of each line; last: the state at a part's end, -1 where the best one is free."""
        best = self._first(shown[parts.begins], opening, before)
        back = np.zeros((len(shown), STATES), np.int8)
        for a, rows in parts.steps():
            through = best[:a, :, None] + self.step
            back[rows] = through.argmax(axis=1)
            best[:a] = through.max(axis=1) + shown[rows]
        states = np.zeros(len(shown), np.int64)
        states[parts.begins + parts.lengths - 1] = np.where(last >= 0, last, best.argmax(axis=1))
        for _, rows in reversed(list(parts.steps())):
            states[rows - 1] = back[rows, states[rows]]
        return states


class Parts:
    """Parts of consecutive lines, longest first, so that all that have a k-th line come first."""

    def __init__(self, begins: np.ndarray, n: int):
        lengths = np.diff(np.append(begins, n))
        self.order = np.argsort(-lengths, kind="stable")
        self.begins, self.lengths = begins[self.order], lengths[self.order]

    def steps(self) -> Iterator[tuple[int, np.ndarray]]:
        """(how many parts have it, its row in each of them) of the second line and those that follow."""
        longer = len(self.lengths) - np.searchsorted(self.lengths[::-1], np.arange(1, int(self.lengths[0])), side="right")
        return ((int(a), self.begins[:a] + k) for k, a in enumerate(longer, 1))


def _in_blocks(lines: DataFrame, *names: str) -> DataFrame:
    """lines with block and key (the transcript as text, null apart), each block sorted in one partition."""
    order = [F.col(c) for c in ("transcript", "turn", "part", "line")]
    key = F.coalesce(F.concat(F.lit("="), F.col("transcript").cast("string")), F.lit("null"))
    placed = with_key_block(lines.select("transcript", "turn", "part", "line", *names), order).withColumnRenamed("_block", "block").withColumn("key", key)
    return placed.repartition("block").sortWithinPartitions("block", *order, *names)


def _borders(frame: pd.DataFrame) -> np.ndarray:
    """Where a block or a transcript begins; the first row does."""
    block, key = frame["block"].to_numpy(), frame["key"].to_numpy()
    return np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (key[1:] != key[:-1])]))


def whole_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches again, cut where a block's part of a transcript ends."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        same = held and held[-1]["block"].iloc[-1] == batch["block"].iloc[0] and held[-1]["key"].iloc[-1] == batch["key"].iloc[0]
        cuts = _borders(batch)[0 if held and not same else 1 :]
        if len(cuts):
            yield pd.concat([*held, batch.iloc[: cuts[-1]]], ignore_index=True)
            held = [batch.iloc[cuts[-1] :]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def learn_turns(lines: DataFrame) -> TurnModel:
    """Count a model from labelled lines (transcript, turn, part, line, role); each count starts at one.

    Lines without one of the known roles are left out; the others of a transcript stand in the order of
    turn and part (nulls first), repeated ones each. A null transcript is one like others. Only counts
    reach the driver, a row for each block. With no lines all states and features are as likely as
    others. Other columns aren't read.
    """
    role = F.expr("case role " + " ".join(f"when '{r}' then {k}" for k, r in enumerate(ROLES)) + " end")
    stated = lines.withColumn("state", (2 * role + (F.col("part") > 0).cast("int")).cast("int")).filter("state is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of each block: start and step counts, a table for each feature, and the states at its ends
        found: dict[int, dict] = {}
        for batch in batches:
            shown = np.array([features(x) for x in batch["line"]], np.int64).reshape(-1, len(SIZES))
            states, keys, blocks = batch["state"].to_numpy(), batch["key"].to_numpy(), batch["block"].to_numpy()
            for b in np.unique(blocks):
                at = np.flatnonzero(blocks == b)
                own = found.setdefault(int(b), {"start": np.zeros(STATES, np.int64), "step": np.zeros((STATES, STATES), np.int64), "tables": [np.zeros((STATES, n), np.int64) for n in SIZES], "first": (keys[at[0]], int(states[at[0]])), "last": None})
                for k, table in enumerate(own["tables"]):
                    np.add.at(table, (states[at], shown[at, k]), 1)
                before = np.concatenate([[own["last"][1] if own["last"] else -1], states[at][:-1]])
                same = np.concatenate([[bool(own["last"]) and own["last"][0] == keys[at[0]]], keys[at][1:] == keys[at][:-1]])
                np.add.at(own["step"], (before[same], states[at][same]), 1)
                fresh = ~same
                fresh[0] &= own["last"] is not None  # whether a block's first line opens a transcript is seen later
                np.add.at(own["start"], states[at][fresh], 1)
                own["last"] = (keys[at[-1]], int(states[at[-1]]))
        for b, own in found.items():
            flat = np.concatenate([own["start"], own["step"].ravel(), *[t.ravel() for t in own["tables"]]])
            yield pd.DataFrame({"block": [b], "first_key": own["first"][0], "first_state": own["first"][1], "last_key": own["last"][0], "last_state": own["last"][1], "counts": [flat]})

    rows = _in_blocks(stated, "state").select("block", "key", "line", "state").mapInPandas(count, "block long, first_key string, first_state int, last_key string, last_state int, counts array<long>").orderBy("block").collect()
    flat = np.sum([r["counts"] for r in rows], axis=0) if rows else np.zeros(STATES + STATES**2 + STATES * sum(SIZES), np.int64)
    start, step = flat[:STATES] + 1.0, flat[STATES : STATES + STATES**2].reshape(STATES, STATES) + 1.0
    for r, previous in zip(rows, [None, *rows], strict=False):
        if previous is not None and previous["last_key"] == r["first_key"]:
            step[previous["last_state"], r["first_state"]] += 1
        else:
            start[r["first_state"]] += 1
    tables, at = [], STATES + STATES**2
    for size in SIZES:
        table = flat[at : at + STATES * size].reshape(STATES, size) + 1.0
        tables.append(np.log(table / table.sum(axis=1, keepdims=True)))
        at += STATES * size
    # a text starts with an opening line, and only a line of the same role goes on with a turn
    allowed = np.array([[t % 2 == 0 or t // 2 == s // 2 for t in range(STATES)] for s in range(STATES)])
    start = np.where(np.arange(STATES) % 2 == 0, start, 1e-9)
    step = np.where(allowed, step, 1e-9)
    return TurnModel(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), tuple(tables))


def _chained(rows: list) -> dict[tuple[str, int], tuple[int, int, int, int]]:
    """(key, block) of each part to the states before it and at its end, and the lines and turns before it;
    from (key, block, n, scores, turns) of all parts of some transcripts."""
    by_key: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["block"]):
        by_key.setdefault(r["key"], []).append(r)
    out = {}
    for key, parts in by_key.items():
        scores, backs = None, []
        for r in parts:
            m = np.array(r["scores"]).reshape(STATES, STATES)
            through = m[:1] if scores is None else scores[:, None] + m
            backs.append(through.argmax(axis=0))
            scores = through.max(axis=0)
        ends = [int(scores.argmax())]
        for back in reversed(backs[1:]):
            ends.append(int(back[ends[-1]]))
        ends, lines, turns = ends[::-1], 0, 0
        for k, r in enumerate(parts):
            before = ends[k - 1] if k else 0
            out[key, r["block"]] = (before if k else -1, ends[k], lines, turns)
            lines += r["n"]
            turns += r["turns"][before * STATES + ends[k]]
    return out


def recover_roles(lines: DataFrame, model: TurnModel) -> DataFrame:
    """lines (transcript, turn, part, line) with at (place in the transcript, from 0), role and opens as
    recovered, turn_no (turns opened before, from 0), and content without marker.

    turn and part only give the lines' order; ties are ordered by the line. Null order values come
    first, a null line is empty, and lines of a null transcript are one transcript. Lines that repeat
    are lines of their own. No lines give none. Of paths with one score the one with the smaller states
    from the end on is taken, inside a block's part of a transcript; which of them joins two parts best
    is told by the state between. Columns besides these aren't read.
    """
    kind = dict(lines.dtypes)["transcript"]
    own = lines.select("transcript", F.col("turn").cast("long").alias("turn"), F.col("part").cast("long").alias("part"), F.col("line").cast("string").alias("line"))
    placed = _in_blocks(own)
    # fewer than there are blocks
    spread = placed.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high").select("key", "low").collect()
    first_block = {r["key"]: r["low"] for r in spread}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in whole_parts(batches):
            parts = Parts(_borders(some), len(some))
            at = some.iloc[parts.begins]
            opening = np.array([first_block[k] == b for k, b in zip(at["key"], at["block"], strict=True)])
            best, turns = model.matrices(model.emissions(some["line"].tolist()), parts, opening)
            yield pd.DataFrame({"key": at["key"].to_numpy(), "block": at["block"].to_numpy(), "n": parts.lengths, "scores": list(best.reshape(len(best), -1)), "turns": list(turns.reshape(len(turns), -1))})

    given = {}
    if spread:
        wanted = F.broadcast(lines.sparkSession.createDataFrame([(k,) for k in first_block], "key string"))
        some = placed.join(wanted, "key", "left_semi").repartition("block").sortWithinPartitions("block", "transcript", "turn", "part", "line")
        given = _chained(some.select("block", "key", "line").mapInPandas(score, "key string, block long, n long, scores array<double>, turns array<long>").collect())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in whole_parts(batches):
            parts, lines = Parts(_borders(some), len(some)), some["line"].tolist()
            at = some.iloc[parts.begins]
            known = np.array([given.get((k, b), (-1, -1, 0, 0)) for k, b in zip(at["key"], at["block"], strict=True)], np.int64)
            states = model.paths(model.emissions(lines), parts, known[:, 0] < 0, known[:, 0], known[:, 1])
            opens = states % 2 == 0
            place, turn = np.empty(len(some), np.int64), np.cumsum(opens)
            part = np.repeat(np.arange(len(parts.begins)), parts.lengths)
            rows = np.repeat(parts.begins, parts.lengths) + np.arange(len(some)) - np.repeat(np.cumsum(parts.lengths) - parts.lengths, parts.lengths)
            place[rows] = rows - parts.begins[part] + known[part, 2]
            upto = np.empty(len(some), np.int64)
            upto[rows] = (turn[parts.begins] - opens[parts.begins])[part] - known[part, 3]
            yield pd.DataFrame({
                "key": some["key"], "turn": some["turn"].astype("Int64"), "part": some["part"].astype("Int64"), "line": some["line"], "at": place,
                "role": [ROLES[s // 2] for s in states.tolist()], "opens": opens, "turn_no": turn - upto - 1, "content": [without_marker(x, o) for x, o in zip(lines, opens.tolist(), strict=True)],
            })

    found = placed.select("block", "key", "turn", "part", "line").mapInPandas(decode, "key string, turn long, part long, line string, at long, role string, opens boolean, turn_no long, content string")
    transcript = F.when(F.col("key") != "null", F.expr("substring(key, 2)")).cast(kind).alias("transcript")
    return found.select(transcript, *[c for c in found.columns if c != "key"])


def render_turns(recovered: DataFrame) -> DataFrame:
    """A row a turn of recover_roles' lines: transcript, turn_no (from 0), first_line, n_lines, role, content, rendered.

    A turn is as long as its lines; a turn of empty lines has empty content. Lines of a null transcript are
    one transcript. No lines give no turns. Columns that recover_roles doesn't make aren't read.
    """
    whole = recovered.groupBy("transcript", "turn_no").agg(
        F.min("at").alias("first_line"),
        F.count(F.lit(1)).alias("n_lines"),
        F.first("role").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n").alias("content"),
    )
    clean = F.regexp_replace(F.btrim("content", F.lit(" \t\r\n")), r"<\|(\w+)\|>", "<$1>")
    return whole.withColumn("content", clean).withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.lit("<|end|>\n")))


# How the raw transcripts of the query write each role.
_WRITTEN = {
    "system": ("System: ", "### System\n", "<|system|>\n", "[system] "),
    "user": ("User: ", "### Human\n", "<|user|>\n", "[user] ", "Q: "),
    "assistant": ("Assistant: ", "### Assistant\n", "<|assistant|>\n", "[assistant] ", "A: "),
}


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as raw lines (transcript, turn, part, line, role).

    Each conversation writes its speakers in one style; an eighth of the turns has no marker at all,
    nor have turns of an unknown or null role. Rows that repeat one another are one turn.
    """
    style = F.xxhash64("conv_id", F.lit("style"))
    marker = F.lit("")
    for role, forms in _WRITTEN.items():
        chosen = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.pmod(style, F.lit(len(forms))) + 1).cast("int"))
        marker = F.when(F.col("role") == role, chosen).otherwise(marker)
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit("bare")), F.lit(8)) == 0
    text = F.concat(F.when(bare, "").otherwise(marker), F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()
    return rows.select(F.col("conv_id").alias("transcript"), F.col("turn").cast("long").alias("turn"), "role", F.posexplode(F.split(text, "\n")).alias("part", "line")).withColumn("part", F.col("part").cast("long"))
