"""Random numbers that depend on nothing but (seed, salt, variation, idx, draw).

The first 32 bits of an md5 make a number in [0, 1). Partitioning, evaluation order and engine don't
matter: DuckDB computes the same numbers from the same text (`sql_uniform`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 4294967296.0


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def uniform(seed, salt, variation, idx, draw=0) -> Column:
    text = F.concat_ws("|", *[as_column(x).cast("string") for x in (seed, salt, variation, idx, draw)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(RANGE)


def randint(u: Column, low, high) -> Column:
    """An integer in [low, high], both included."""
    low, high = as_column(low), as_column(high)
    return (low + F.floor(u * (high - low + 1))).cast("long")


def choice(u: Column, items: Column) -> Column:
    return F.element_at(items, (F.floor(u * F.size(items)) + 1).cast("int"))


def sql_uniform(seed, salt, variation, idx, draw=0) -> str:
    """DuckDB's form of uniform; arguments are SQL expressions."""
    text = "||'|'||".join(f"({x})::VARCHAR" for x in (seed, salt, variation, idx, draw))
    return f"(('0x'||substr(md5({text}),1,8))::BIGINT/4294967296.0::DOUBLE)"
