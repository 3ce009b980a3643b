"""Epochs as written tables that are read in order from any sample on.

Rows lie in folders of block_rows consecutive idx each. So reading from a sample on opens only the files of its
block and later ones, and going through an epoch in order sorts one block at a time and never all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a block: what one task writes and sorts, and the driver holds when it iterates.
BLOCK_ROWS = 1 << 14
_BLOCK, _SCHEMA = "_block", "_schema"


@dataclass(frozen=True)
class WrittenEpoch:
    """An epoch's rows (dense idx) below path; the same path in another session reads the same rows."""

    spark: SparkSession
    path: str
    block_rows: int = BLOCK_ROWS

    @classmethod
    def of(cls, df: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> WrittenEpoch:
        """The epoch at path: written from df if it isn't there whole yet, else as it is."""
        epoch = cls(df.sparkSession, path, block_rows)
        if not epoch.whole():
            rows = df.withColumn(_BLOCK, F.expr(f"idx div {block_rows}"))
            rows.repartition(_BLOCK).sortWithinPartitions(_BLOCK, "idx").write.mode("overwrite").partitionBy(_BLOCK).parquet(path)
            # last, so that it says that all is there; an epoch without rows has no file that knows its columns
            files, where = epoch._files(_SCHEMA)
            out = files.create(where)
            out.write(rows.schema.json().encode())
            out.close()
        return epoch

    def _files(self, name: str = ""):
        """(file system, path) of the folder or of a name in it."""
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(context._jsc.hadoopConfiguration()), where

    def whole(self) -> bool:
        files, where = self._files(_SCHEMA)
        return files.exists(where)

    def _rows(self) -> DataFrame:
        files, where = self._files(_SCHEMA)
        stream = files.open(where)  # Spark's readers pass over such names
        said = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return self.spark.read.schema(StructType.fromJson(json.loads(said))).parquet(self.path)

    def blocks(self) -> list[int]:
        """Numbers of the blocks, from the names of their folders."""
        files, where = self._files()
        names = [f.getPath().getName() for f in files.listStatus(where)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{_BLOCK}="))

    def since(self, index: int) -> DataFrame:
        """Rows from a sample on; only files of its block and of later ones are read."""
        return self._rows().filter((F.col(_BLOCK) >= index // self.block_rows) & (F.col("idx") >= index)).drop(_BLOCK)

    def iterate(self, index: int = 0) -> Iterator:
        """Rows in order from a sample on, a block at a time."""
        for block in self.blocks():
            if (block + 1) * self.block_rows > index:
                rows = self._rows().filter(F.col(_BLOCK) == block)
                yield from rows.filter(F.col("idx") >= index).drop(_BLOCK).orderBy("idx").collect()
