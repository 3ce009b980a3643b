"""Text functions with Python's meaning of stripping, splitting and case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS = r"(?U)^\s+|\s+$"
#: The path without its extension; leading dots of the last name are no extension.
STEM = r"^((?:.*/)?\.*[^/.][^/]*)\.[^./]*$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _ENDS, "")


def quoted(delimiter: Column) -> Column:
    """A pattern for the delimiter as it stands."""
    return F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))


def split_plain(x: Column, delimiter: Column) -> Column:
    return F.split(x, quoted(delimiter))


def join_with(items: Column, delimiter: Column) -> Column:
    return F.call_function("array_join", items, delimiter)


def stripped_tags(x: Column, delimiter: Column) -> Column:
    return F.filter(F.transform(split_plain(x, delimiter), strip), lambda t: t != "")


def head_and_rest(items: Column, count: Column) -> tuple[Column, Column]:
    """items[:count] and items[count:], with Python's meaning of negative counts."""
    n = F.size(items)
    end = F.when(count < 0, F.greatest(n + count, F.lit(0))).otherwise(F.least(count, n)).cast("int")
    return F.slice(items, F.lit(1), end), F.slice(items, end + 1, n)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, STEM, "$1")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def capwords(x: Column) -> Column:
    return F.initcap(F.lower(F.regexp_replace(strip(x), r"(?U)\s+", " ")))


def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))


def bound(x: Column, fn) -> Column:
    """fn(x) with x computed once: as an expression it would be computed wherever fn names it, in a
    lambda even once for each element."""
    return F.element_at(F.transform(F.array(x), fn), 1)
