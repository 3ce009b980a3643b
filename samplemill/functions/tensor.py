"""Tensors as structs: shape (array<int>, C[,F],H,W) and data (row-major array<float>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TENSOR = "struct<shape:array<int>,data:array<float>>"


def tensor(shape: Column, data: Column) -> Column:
    return F.struct(shape.cast("array<int>").alias("shape"), data.cast("array<float>").alias("data"))


def literal_shape(*sizes: int) -> Column:
    return F.array(*[F.lit(s) for s in sizes])


def or_null(t: Column) -> Column:
    """Null for a tensor without data. t, a Python function's result, is named once: it runs for each naming."""
    return F.element_at(F.transform(F.array(t), lambda x: F.when(x["data"].isNotNull(), x)), 1)


def height(t: Column) -> Column:
    return F.element_at(t["shape"], -2)


def width(t: Column) -> Column:
    return F.element_at(t["shape"], -1)


def volume(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1), lambda s, x: s * x)


def mapped(t: Column, fn) -> Column:
    """fn(value, flat index) over the data; a null tensor stays null."""
    return F.when(t.isNotNull(), tensor(t["shape"], F.transform(t["data"], fn)))


def indices(n: Column) -> Column:
    """[0, ..., n - 1]; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def crop(t: Column, top: Column, left: Column, h: Column, w: Column) -> Column:
    """h x w from (top, left) of each plane."""
    planes = (F.size(t["data"]) / (height(t) * width(t))).cast("int")
    at = lambda k: (k / (h * w)).cast("int") * height(t) * width(t) + (top + (k % (h * w) / w).cast("int")) * width(t) + left + k % w
    data = F.transform(indices((planes * h * w).cast("int")), lambda k: F.get(t["data"], at(k).cast("int")))
    lead = F.slice(t["shape"], F.lit(1), F.size(t["shape"]) - 2)
    return F.when(t.isNotNull(), tensor(F.concat(lead, F.array(h.cast("int"), w.cast("int"))), data))


def flipped(t: Column) -> Column:
    """Each line reversed."""
    w = width(t)
    return mapped(t, lambda v, i: F.get(t["data"], i - i % w + w - 1 - i % w))


def filled_like(t: Column, values: Column) -> Column:
    """A tensor of t's size without its first dimension, a plane for each value."""
    rest = F.slice(t["shape"], F.lit(2), F.size(t["shape"]) - 1)
    plane = volume(rest)
    data = F.flatten(F.transform(values, lambda v: F.array_repeat(v, plane.cast("int"))))
    return F.when(t.isNotNull(), tensor(F.concat(F.array(F.size(values)), rest), data))
