"""Sequence packing: first-fit decreasing over a tournament tree, in randomised groups of documents.

Each document is tokenized, closed with an end id and cut into pieces: as many full sequences as it
fills, and a rest. The pieces are dealt to groups by a hash of the row, so that neither one source
nor one long document makes a group large; each group is packed alone by first-fit decreasing. The
open bins are the leaves of a tournament tree whose inner nodes hold the largest free capacity
below, so that the first bin with room is found in a logarithm of steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, public_path

SEQUENCE_TOKENS = 2048
#: Pieces of a group, at most as expected. Groups grow in number with the input, never in size.
GROUP_PIECES = 4096
END_ID = 1
#: Sequence ids of a group start at the group's number times this.
GROUP_STRIDE = 1 << 32


class CapacityTree:
    """Tournament tree of free capacities: the leftmost bin that holds a length, in log steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.top = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        top, node = self.top, 1
        while node < self.leaves:
            node *= 2
            if top[node] < length:
                node += 1
        found, left = node - self.leaves, top[node] - length
        top[node] = left
        while node > 1:
            other = top[node ^ 1]
            left = left if left >= other else other
            node //= 2
            if top[node] == left:
                break
            top[node] = left
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each length; lengths are between 1 and the capacity."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = CapacityTree(len(lengths), capacity), {}
    for i in order.tolist():
        n = int(lengths[i])
        b = tree.place(n)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = int(offsets[i]) + n
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer: str, sequence_tokens: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row a piece: doc_id, row_key (hash of the text), start, length, ids_crc32, doc_tokens (and ids)."""
    step = 4 * sequence_tokens
    schema = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc_id, key, text in zip(batch["doc_id"], batch["row_key"], batch["text"], strict=True):
                ids = enc.encode(text) + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    out.append((doc_id, key, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece)[: 6 + keep_ids])
            frame = pd.DataFrame(out, columns=["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 + keep_ids])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    return rows.mapInPandas(cut, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    sequence_tokens: int = SEQUENCE_TOKENS,
    group_pieces: int = GROUP_PIECES,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack the whole texts of docs (doc_id, text) into sequences of at most sequence_tokens ids.

    Returns a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens (ids in its sequence), padded_tokens (its length after padding: a power of two
    stays, all else is padded to the full length) and, with keep_ids, ids (little-endian unsigned
    32-bit). Sequences are gapless from offset 0. Groups depend on the rows alone, so a task that runs
    again deals its pieces alike.

    Nulls: a null or empty text is the end id alone; a null doc_id is kept. Rows that repeat are
    documents of their own: their pieces are counted before the shuffle and dealt in lots of
    group_pieces. Very long texts are cut into pieces that spread over the groups. An empty table gives
    an empty result. Columns besides doc_id and text aren't read.
    """
    pieces = cut_documents(docs, tokenizer or public_path("byte_bpe_50k.json"), sequence_tokens, end_id, keep_ids)
    # a token has one octet at least: so many pieces at most
    size = docs.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1)).first()
    groups = max(1, -(-(int(size[0]) + int(size[1] or 0) // sequence_tokens) // group_pieces))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    kinds = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "ids": "binary"}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long, sequence_tokens long, padded_tokens long"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["pack_group"].iloc[0])
        frame = frame.sort_values(["doc_id", "row_key", "start", "lot"], ignore_index=True)
        frame = frame.loc[np.repeat(frame.index, frame["copies"])].reset_index(drop=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), sequence_tokens)
        full = np.bincount(bins, weights=frame["length"]).astype(np.int64)[bins]
        return frame[names].assign(
            doc_id=frame["doc_id"].astype("Int64"),
            sequence_id=group * GROUP_STRIDE + bins,
            offset=offsets,
            sequence_tokens=full,
            padded_tokens=np.where(full & (full - 1) == 0, full, sequence_tokens),
        )

    counted = [F.count(F.lit(1)).alias("n")] + [F.first("ids").alias("ids")] * keep_ids
    once = pieces.groupBy("doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens").agg(*counted)
    lots = once.withColumn("lot", F.explode(F.expr(f"sequence(0, (n - 1) div {group_pieces})"))).withColumn("copies", F.expr(f"least({group_pieces}, n - lot * {group_pieces})"))
    grouped = lots.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "row_key", "start", "lot"), F.lit(groups)))
    return grouped.groupBy("pack_group").applyInPandas(pack, schema)


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """Pieces of pack_documents with ids to a row a sequence: sequence_id, ids (padded with pad_id to
    padded_tokens), segment_lengths and doc_ids (in the order of the pieces).

    A null doc_id stays null; repeated rows and pieces of long texts are segments of their own. No
    pieces: no sequences. Other columns aren't read.
    """

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset")
        ids = b"".join(frame["ids"])
        ids += pad_id.to_bytes(4, "little") * (int(frame["padded_tokens"].iloc[0]) - len(ids) // 4)
        return pd.DataFrame({
            "sequence_id": [frame["sequence_id"].iloc[0]],
            "ids": [np.frombuffer(ids, "<u4").astype(np.int64)],
            "segment_lengths": [frame["length"].tolist()],
            "doc_ids": [[None if pd.isna(d) else int(d) for d in frame["doc_id"]]],
        })

    return pieces.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>, segment_lengths array<long>, doc_ids array<long>")
