"""Order of an epoch: batches of one resolution, and shards for consumers.

Rows are numbered inside their bucket, in blocks, so that no task sorts a whole bucket. Only the
batches, a row for each, are put in one order; a batch's rows follow from its number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.index import dense_index, number_block, uniform_block
from ..plans.stage import Context, Stage, carried, resolve


def _numbered_batches(batches: DataFrame, order: list[Column], block: Column, batch_size: int) -> DataFrame:
    """batches (bucket, batch, ...) with `first`, the idx of a batch's first row."""
    return dense_index(batches, order, "number", block=block).withColumn("first", F.col("number") * batch_size)


def _placed(rows: DataFrame, numbered: DataFrame, batch_size: int, names: list[str]) -> DataFrame:
    """Rows whose batch has a number, with the idx that follows from it."""
    given = numbered.select(F.col("variation").alias("_v"), F.col("_bucket").alias("_b"), F.col("_batch").alias("_t"), "first")
    out = rows.join(given, F.col("variation").eqNullSafe(F.col("_v")) & F.col("_bucket").eqNullSafe(F.col("_b")) & (F.col("_batch") == F.col("_t")))
    return out.select("variation", (F.col("first") + F.col("_pos") % batch_size).cast("long").alias("idx"), *names)


@dataclass
class AspectBatchSorting(Stage):
    """Whole batches of rows with one resolution: rows shuffled inside their bucket, batches shuffled
    among all. What doesn't fill a batch of its bucket is left out."""

    CARRIES = ("names",)

    resolution_in: str
    names: list[str]
    batch_size: int

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        size = self.batch_size
        rows = df.select("variation", "idx", *carried(df, self.names), resolve(df, self.resolution_in).alias("_bucket"))
        rows = rows.withColumn("_key", self.random(ctx, "row"))
        placed = dense_index(rows, [F.col("_key"), F.col("idx")], "_pos", ("variation", "_bucket"), uniform_block(df, F.col("_key")), "_n")
        whole = placed.filter(F.col("_pos") < F.expr(f"(_n div {size}) * {size}")).withColumn("_batch", F.expr(f"_pos div {size}"))
        batches = whole.select("variation", "_bucket", "_batch").distinct()
        text = F.concat_ws("|", F.lit("batch"), F.col("_bucket").cast("string"), F.col("_batch").cast("string"))
        drawn = self.random(ctx, text, idx=F.lit(-1))
        numbered = _numbered_batches(batches, [drawn, F.col("_bucket"), F.col("_batch")], uniform_block(df, drawn), size)
        return _placed(whole, numbered, size, carried(df, self.names))


@dataclass
class InlineAspectBatchSorting(Stage):
    """The streaming order: rows arrive shuffled; a bucket's batch is given out when its last row has
    arrived. Partial batches are left out; start_index skips so many arrivals. in_order: rows arrive by
    idx instead."""

    CARRIES = ("names",)

    resolution_in: str
    names: list[str]
    batch_size: int
    start_index: int = 0
    in_order: bool = False

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        size, names = self.batch_size, carried(df, self.names)
        rows = df.select("variation", "idx", *names, resolve(df, self.resolution_in).alias("_bucket"))
        drawn = self.random(ctx, "row")
        rows = rows.withColumn("_seq", F.col("idx")) if self.in_order else dense_index(rows, [drawn, F.col("idx")], "_seq", block=uniform_block(df, drawn))
        rows = rows.filter(F.col("_seq") >= self.start_index)
        placed = dense_index(rows, [F.col("_seq")], "_pos", ("variation", "_bucket"), number_block(F.col("_seq"))).withColumn("_batch", F.expr(f"_pos div {size}"))
        batches = placed.groupBy("variation", "_bucket", "_batch").agg(F.max("_seq").alias("done"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == size).drop("n")
        numbered = _numbered_batches(batches, [F.col("done")], number_block(F.col("done")), size)
        return _placed(placed, numbered, size, names)


@dataclass
class DistributedSampler(Stage):
    """Every world_size-th row from rank on; an incomplete last round is left out. Needs a dense idx."""

    CARRIES = ("names",)

    names: list[str]
    world_size: int
    rank: int

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        rounds = df.groupBy("variation").agg(F.expr(f"(max(idx) + 1) div {self.world_size}").alias("_rounds"))
        own = df.filter(F.col("idx") % self.world_size == self.rank).join(F.broadcast(rounds), "variation").filter(F.expr(f"idx div {self.world_size} < _rounds"))
        return own.select("variation", F.expr(f"idx div {self.world_size}").alias("idx"), *carried(df, self.names))


class InlineDistributedSampler(DistributedSampler):
    """DistributedSampler behind an ordered stage: the same rows."""
