"""What driver and executors share: a folder, and the size of the batches between the JVM and Python."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch at most: what a worker and the JVM beside it hold of texts or tensors at once, some times over.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark cut Arrow batches at BATCH_BYTES from now on, unless the session has a smaller limit; its default of
    64 MiB takes several times as much beside the heap of an executor with two tasks."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bounded_batches for the jobs inside; the session's own limit holds again behind them."""
    before = spark.conf.get(_BATCH)
    bounded_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the checkpoint folder it was given.

    Only a session whose master runs in this one process gets a temporary folder where neither is set;
    on a cluster executors would not see it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = named or context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="samplemill-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder of its own (not yet made) below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
