"""Dense row numbers without one task that sorts everything or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of numbers that are dense already.
BLOCK_ROWS = 1 << 16
#: Keys that the bounds of a block are drawn from.
KEYS_A_BLOCK = 32


def blocks_of(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def number_block(number: Column) -> Column:
    """The block of a row by a number that is dense or nearly so."""
    return F.floor(number / BLOCK_ROWS).cast("long")


def uniform_block(df: DataFrame, u: Column) -> Column:
    """The block of a row by a number that is uniform in [0, 1)."""
    return F.floor(u * blocks_of(df)).cast("long")


def with_key_block(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with _block, cut by any ascending keys at bounds that all uses of the rows agree on.

    The bounds are quantiles of the keys with the smallest hashes: a sample that depends on the rows
    alone, not on their partitions, and is one small subquery of the plan. A row finds its block by
    bisection.
    """
    n, key = blocks_of(df), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    drawn = df.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(KEYS_A_BLOCK * n).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    place = lambda i: F.floor(i * F.size("keys") / F.lit(n)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("keys", place(i))) if n > 1 else F.slice("keys", 1, 0)
    bounds = drawn.select(F.filter(cuts, lambda k: k.isNotNull()).alias("bounds")).scalar()
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    ends = F.col("_bounds")
    found = F.aggregate(steps, F.lit(0), lambda low, s: F.when((low + s <= F.size(ends)) & (F.get(ends, low + s - 1) <= F.col("_key")), low + s).otherwise(low))
    return df.withColumns({"_bounds": bounds, "_key": key}).withColumn("_block", F.coalesce(found.cast("long"), F.lit(0).cast("long"))).drop("_bounds", "_key")


def dense_index(df: DataFrame, order: list[Column], name: str = "idx", by: tuple[str, ...] = (), block: Column | None = None, total: str | None = None) -> DataFrame:
    """Number the rows of each `by` from 0 in the given ascending order; total: a name for their count.

    Rows are numbered inside blocks of the order and shifted by the rows in the blocks before, of which
    one number a block is summed; no task sorts a whole group. block: a column that never falls along
    the order and depends on the row alone; without it blocks are cut by with_key_block. A row's block is
    computed from its own keys, so the numbered rows and the counts agree however often either is made.
    """
    rows = with_key_block(df, order) if block is None else df.withColumn("_block", block)
    counts = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    shifts = [(F.sum("_n").over(upto.orderBy("_block")) - F.col("_n")).alias("_before"), F.sum("_n").over(upto).alias("_total")]
    before = counts.select(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], F.col("_block").alias("_of"), *shifts)
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order)) - 1)
    same = F.col("_block") == F.col("_of")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    numbers = [(F.col("_before") + F.col("_at")).cast("long").alias(name)] + ([F.col("_total").alias(total)] if total else [])
    return placed.join(before, same).select(*[c for c in df.columns if c not in (name, total)], *numbers)
