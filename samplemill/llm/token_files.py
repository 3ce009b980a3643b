"""Token ids in files: frequency-ranked ids, byte-aligned codes, separate control bytes.

All ids of the corpus are counted; the most frequent id gets rank 0. A rank takes one to four bytes,
and two bits of a control byte say how many. A file holds blocks of whole documents:

    FRVB1\\n
    block: 5 unsigned 32-bit numbers (documents, null flags' bytes, ids, control bytes, data bytes),
           doc_ids (signed 64-bit), null flags, ids of each document (unsigned 64-bit), control, data

all little-endian. ranks.u32 beside the files holds the id of each rank. Decoding looks the lengths of
four codes up by their control byte, sums them to offsets, and gathers bytes: numpy throughout.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import file_system, new_folder, write_atomically, written
from .tokens import encoder, public_path

END_ID = 1
BLOCK_IDS = 1 << 20
MAGIC = b"FRVB1\n"
_HEAD = "<5I"
#: Lengths of the four codes of each control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_codes(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of pack_codes."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    source = np.frombuffer(data, np.uint8)
    out = source[at].astype(np.uint32) if n else np.empty(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= source[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, row_key, ids (little-endian unsigned 32-bit) with the end id, as a written table."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            # halves: ids below 65,536 make the upper halves zeros, which compress away
            ids = [np.frombuffer(enc.encode(t) + end, "<u2").reshape(-1, 2) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row_key": batch["row_key"], "low": [x[:, 0].tobytes() for x in ids], "high": [x[:, 1].tobytes() if x[:, 1].any() else None for x in ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInPandas(encode, "doc_id long, row_key long, low binary, high binary"), "token-ids")


def _ids(low: bytes, high: bytes | None) -> np.ndarray:
    out = np.frombuffer(low, "<u2").astype(np.uint32)
    return out if high is None else out | np.frombuffer(high, "<u2").astype(np.uint32) << np.uint32(16)


def id_counts(ids: DataFrame) -> DataFrame:
    """id, n over all documents; each task sums its own first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            narrow = batch["high"].isna()
            some = [np.frombuffer(b"".join(batch["low"][narrow]), "<u2")]  # documents with small ids are counted at once
            some += [_ids(low, high) for low, high in zip(batch["low"][~narrow], batch["high"][~narrow], strict=True)]
            for found in map(np.bincount, some):
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    return ids.select("low", "high").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


@cache
def _ranked(path: str) -> np.ndarray:
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read(), "<u4")


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write the ids of all whole texts of docs (doc_id, text) to files in ascending doc_id order.

    Returns the files: part, path, ranks (path), n_docs, n_ids and start (ids in the files before).
    files: how many (the session's shuffle partitions unless given); equal doc_ids may lie in two.

    A null or empty text is the end id alone. A null doc_id comes first and stays null. Rows with one
    doc_id are ordered by a hash of their text; rows that repeat one another are all written. Very long
    texts are one document in a block of their own. An empty table gives no documents. Columns besides
    doc_id and text aren't read. Only counts by token id reach the driver: a row for an id of the
    vocabulary.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    ids = tokenized(docs, tokenizer or public_path("word_bpe_49k.json"), end_id)
    ranked = id_counts(ids).orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy(np.int64).astype("<u4")
    ranks_path = f"{folder}/ranks.u32"
    write_atomically(ranks_path, [ranked.tobytes()])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), [0, 0]
        ids_of = _ranked(ranks_path)
        rank_of = np.zeros(int(ids_of.max()) + 1 if len(ids_of) else 1, np.uint32)
        rank_of[ids_of] = np.arange(len(ids_of), dtype=np.uint32)

        def block(held: list) -> bytes:
            lengths = np.array([len(x) for _, x in held], "<u8")
            null = np.packbits([d is None for d, _ in held])
            control, data = pack_codes(rank_of[np.concatenate([x for _, x in held])])
            total[0] += len(held)
            total[1] += int(lengths.sum())
            return b"".join([struct.pack(_HEAD, len(held), len(null), int(lengths.sum()), len(control), len(data)), np.array([d or 0 for d, _ in held], "<i8").tobytes(), null.tobytes(), lengths.tobytes(), control, data])

        def blocks() -> Iterator[bytes]:
            yield MAGIC
            held, n = [], 0
            for batch in batches:
                for doc_id, low, high in zip(batch["doc_id"].astype("Int64"), batch["low"], batch["high"], strict=True):
                    held.append((None if pd.isna(doc_id) else int(doc_id), _ids(low, high)))
                    n += len(held[-1][1])
                    if n >= BLOCK_IDS:
                        yield block(held)
                        held, n = [], 0
            if held:
                yield block(held)

        path = f"{folder}/part-{part:06d}.frvb"
        write_atomically(path, blocks())
        yield pd.DataFrame({"part": [part], "path": [path], "ranks": [ranks_path], "n_docs": total[:1], "n_ids": total[1:]})

    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "row_key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row_key")
    manifest = written(dealt.mapInPandas(write, "part long, path string, ranks string, n_docs long, n_ids long"), "token-manifest")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents of write_token_files' files: doc_id, start (ids before it), n_tokens, ids (binary, unsigned 32-bit)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ranks, start in zip(batch["path"], batch["ranks"], batch["start"], strict=True):
                ids_of = _ranked(ranks)
                system, at = file_system(path)
                with system.open_input_stream(at) as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{path} isn't a token file")
                    while head := f.read(struct.calcsize(_HEAD)):
                        n, nulls, n_ids, n_control, n_data = struct.unpack(_HEAD, head)
                        docs = np.frombuffer(f.read(8 * n), "<i8")
                        null = np.unpackbits(np.frombuffer(f.read(nulls), np.uint8))[:n].astype(bool)
                        ends = np.cumsum(np.frombuffer(f.read(8 * n), "<u8").astype(np.int64))
                        ids = ids_of[unpack_codes(f.read(n_control), f.read(n_data), n_ids)].tobytes()
                        begins = np.concatenate([[0], ends[:-1]])
                        yield pd.DataFrame({
                            "doc_id": pd.array(docs, "Int64") if not null.any() else pd.arrays.IntegerArray(docs.copy(), null),
                            "start": start + begins,
                            "n_tokens": ends - begins,
                            "ids": [ids[4 * b : 4 * e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)],
                        })
                        start += n_ids

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")
