"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import BATCH_BYTES, bounded_batches, new_folder, shared_dir  # noqa: F401

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before until df has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a written table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def as_uri(path: str) -> str:
    """Spark's file:/x and plain /x as file:///x, which pyarrow's file systems read."""
    if path.startswith("file:"):
        return "file://" + path.removeprefix("file:").replace("//", "/", 1).rstrip("/")
    return "file://" + os.path.abspath(path) if path.startswith("/") else path


def file_system(path: str):
    """(pyarrow file system, path there) of a shared folder; local, HDFS, S3 and GCS alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(as_uri(path))


def write_atomically(path: str, parts) -> int:
    """Write byte strings to a shared file under a temporary name and move it in place.

    A task that runs twice writes the same file twice, and readers see whole files only.
    """
    system, target = file_system(path)
    system.create_dir(str(Path(target).parent), recursive=True)
    temporary, size = f"{target}.{uuid.uuid4().hex}.tmp", 0
    with system.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(temporary, target)
    return size


#: In a worker: the operator whose memo is in use, and what empties it.
_memo_in_use: dict[str, Callable[[], None]] = {}


def use_memo(owner: str, empty: Callable[[], None]) -> None:
    """Say in a worker that owner's memo is in use from now on; another operator's is emptied.

    Spark uses workers again, so that the memos of all operators of a session would add up.
    empty is a function of a module: a nested one would be shipped with a copy of the memo.
    """
    for other in [o for o in _memo_in_use if o != owner]:
        _memo_in_use.pop(other)()
    _memo_in_use[owner] = empty


def row_hash(*columns: str):
    """64-bit hash of the columns; nulls count as a value of their own."""
    return F.xxhash64(*columns)
