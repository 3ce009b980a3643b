"""Grouping and balancing: each group gives n * balancing rows (REPEATS) or a number of rows (SAMPLES).

Rows of a group are taken in turn, and go on in the next epoch where this one stopped. A group's first
row says how it is balanced. The groups' sizes are a small table; rows meet it in one equi-join, and are
numbered in blocks, so that a group with most of the rows still spreads over all tasks.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.index import dense_index, number_block
from ..functions.shared import new_folder
from ..plans.stage import Context, Stage, carried, resolve
from .tags import flag

REPEATS, SAMPLES = "REPEATS", "SAMPLES"
#: Repeats of a row that are made from one array.
TURNS = 1 << 16
#: Rows of a cached group that one task writes.
CACHED_ROWS = 1 << 20


def groups(df: DataFrame, by: list[str], balancing_in: str, strategy_in: str) -> DataFrame:
    """A row a group: its keys g0, g1, ..., first (smallest idx), n, n_out, before (rows of groups before)."""
    keys = [resolve(df, b).alias(f"g{k}") for k, b in enumerate(by)]
    rows = df.select("idx", *keys, resolve(df, balancing_in).cast("double").alias("balancing"), resolve(df, strategy_in).alias("strategy"))
    found = rows.groupBy(*[f"g{k}" for k in range(len(by))]).agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"), F.min_by("balancing", "idx").alias("balancing"), F.min_by("strategy", "idx").alias("strategy"))
    count = F.when(F.col("strategy") == REPEATS, F.floor(F.col("n") * F.col("balancing"))).when(F.col("strategy") == SAMPLES, F.col("balancing").cast("long"))
    n_out = count.otherwise(F.raise_error(F.concat(F.lit("unknown balancing strategy "), F.coalesce("strategy", F.lit("null")))).cast("long"))
    counted = found.withColumn("n_out", n_out).filter("n_out > 0").drop("balancing", "strategy").withColumn("_part", number_block(F.col("first")))
    # the rows of groups before: of earlier parts, a row for each, and of this one
    parts = counted.groupBy("_part").agg(F.sum("n_out").alias("_n")).select(F.col("_part").alias("_of"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_earlier"))
    inner = F.sum("n_out").over(Window.partitionBy("_part").orderBy("first")) - F.col("n_out")
    return counted.withColumn("_inner", inner).join(parts, F.col("_part") == F.col("_of")).withColumn("before", F.col("_earlier") + F.col("_inner")).drop("_part", "_of", "_earlier", "_inner")


def expand(df: DataFrame, variation: int, by: list[str], balancing_in: str, strategy_in: str, enabled_in: str | None) -> DataFrame:
    """The balanced rows: the columns of df with a new dense idx, variation, and in_variation.

    A group gives its rows in turn: the j-th of this epoch is the row at (j + variation * n_out) mod n. So
    each row knows from its place which j it stands for, and emits those itself.
    """
    kept = df.filter(flag(df, enabled_in))
    table = groups(kept, by, balancing_in, strategy_in)
    table = table.select(*[F.col(c).alias(f"_of_{c}") for c in table.columns])  # df may have columns of these names
    keys = [f"_g{k}" for k in range(len(by))]
    keyed = kept.select("*", *[resolve(kept, b).alias(k) for k, b in zip(keys, by, strict=True)])
    placed = dense_index(keyed, [F.col("idx")], "_place", tuple(keys), number_block(F.col("idx")))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    sized = placed.join(table, match).withColumn("_j", F.expr(f"pmod(_place - {variation} * _of_n_out, _of_n)")).filter("_j < _of_n_out")
    # every n-th j from the first on: in two steps, so that no row builds a long array
    sized = sized.withColumn("_turn", F.explode(F.expr(f"sequence(0, (_of_n_out - 1 - _j) div _of_n div {TURNS})")))
    last = F.expr(f"least((_of_n_out - 1 - _j) div _of_n, (_turn + 1) * {TURNS} - 1)")
    each = sized.withColumn("_again", F.explode(F.sequence(F.col("_turn") * TURNS, last))).withColumn("_j", F.col("_j") + F.col("_again") * F.col("_of_n"))
    rest = [c for c in df.columns if c not in ("idx", "variation", "in_variation")]
    in_variation = F.expr(f"(_j + {variation} * _of_n_out) div _of_n").cast("int").alias("in_variation")
    return each.select(F.lit(variation).alias("variation"), (F.col("_of_before") + F.col("_j")).cast("long").alias("idx"), in_variation, *rest)


@dataclass
class VariationSorting(Stage):
    """Balanced rows with the columns in names, for the current variation."""

    CARRIES = ("names",)

    names: list[str]
    balancing_in: str
    balancing_strategy_in: str
    variations_group_in: list[str]
    group_enabled_in: str | None = None

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        out = expand(df, ctx.variation, self.variations_group_in, self.balancing_in, self.balancing_strategy_in, self.group_enabled_in)
        return out.select("variation", "idx", *carried(df, self.names))


@dataclass
class RamCache(Stage):
    """Balanced rows of an epoch, kept in executor memory and on their disks until the pipeline goes on to the
    next epoch. make: what computes the cached columns from rows whose variation is the one they are
    repeated for."""

    CARRIES = ("cache_names",)

    def inputs(self) -> list[str]:
        made = {n for stage in self.make for n in stage.outputs()}
        inner = [n for stage in self.make for n in stage.inputs()]
        return [n for n in dict.fromkeys([*super().inputs(), *inner, *self.carries()]) if n.split(".")[0] not in made]

    cache_names: list[str]
    balancing_in: str | None = None
    balancing_strategy_in: str | None = None
    variations_group_in: list[str] | None = None
    group_enabled_in: str | None = None
    before_cache: Callable[[], None] | None = None
    make: list[Stage] = field(default_factory=list)

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        if self.before_cache:
            self.before_cache()
        if self.balancing_in is None:
            rows = df.withColumn("in_variation", F.lit(ctx.variation))
        else:
            rows = expand(df, ctx.variation, self.variations_group_in, self.balancing_in, self.balancing_strategy_in, self.group_enabled_in)
        made = rows.withColumn("variation", F.col("in_variation"))
        for stage in self.make:
            made = stage.apply(made, ctx)
        cached = made.withColumn("variation", F.lit(ctx.variation)).select("variation", "idx", "in_variation", *carried(made, self.cache_names)).persist()
        ctx.meta.setdefault("cached", []).append(cached)
        return cached


@dataclass
class Materialize(Stage):
    """The rows as a table written to the shared folder. Stages that index anew read their rows several times;
    behind Python-heavy columns they should read a table (or a cache), not compute the columns again."""

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        path = new_folder(ctx.spark, "rows")
        df.write.parquet(path)
        return ctx.spark.read.schema(df.schema).parquet(path)


class CacheFolder:
    """The written tables that make one variation's cache, named by a list that is replaced as a whole.

    A list is a file with a number of its own, written under another name and moved in place; the
    greatest number counts. So readers see a cache before or after a change, never half of one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark.sparkContext._jvm
        self.files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _lists(self) -> list[int]:
        if not self.files.exists(self._at("")):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self._at(""))]
        return sorted(int(n.removeprefix("list-")) for n in names if n.startswith("list-"))

    def tables(self) -> list[str]:
        numbers = self._lists()
        if not numbers:
            return []
        return [r["value"] for r in self.spark.read.text(f"{self.path}/list-{numbers[-1]:08d}").collect()]

    def write(self, df: DataFrame) -> str:
        name = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def replace(self, tables: list[str]) -> None:
        """From now on these tables count; those that neither this list nor the one before it names go."""
        numbers, before = self._lists(), self.tables()
        hidden, name = self._at(f".list-{uuid.uuid4().hex}"), self._at(f"list-{(numbers[-1] if numbers else 0) + 1:08d}")
        out = self.files.create(hidden)
        out.write("\n".join(tables).encode())
        out.close()
        if not self.files.rename(hidden, name):
            raise OSError(f"{name} can't be written")
        for f in self.files.listStatus(self._at("")):
            other = f.getPath().getName()
            if (other.startswith("rows-") and other not in {*tables, *before}) or (other.startswith("list-") and int(other.removeprefix("list-")) < (numbers[-1] if numbers else 0)):
                self.files.delete(f.getPath(), True)

    def read(self, schema) -> DataFrame:
        paths = [f"{self.path}/{t}" for t in self.tables()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


@dataclass
class DiskCache(Stage):
    """Balanced rows with columns from a Parquet cache, a folder a variation.

    A cached row knows its place and a print: a hash of what the stages in make read of its row, and of
    these stages. So a row whose values changed, or all where a stage did, is made again and no other, and a
    cache is never stale; rows that are gone are passed over. What a column only points to (a file's contents)
    belongs in print_names, such as its time of change. Each filling adds a table; from TABLES on they are
    put together, without what no row has any more. split_names and aggregate_names are columns alike:
    pruning reads few.

    Filling runs while the plan is built, or before by fill(); with filled, apply only reads.
    """

    CARRIES = ("split_names", "aggregate_names")
    #: Tables of a variation that are put together.
    TABLES = 8

    def inputs(self) -> list[str]:
        made = {n for stage in self.make for n in stage.outputs()}
        inner = [n for stage in self.make for n in stage.inputs()]
        return [n for n in dict.fromkeys([*super().inputs(), *inner, *self.print_names, *self.carries()]) if n.split(".")[0] not in made]

    cache_dir: str
    split_names: list[str]
    aggregate_names: list[str]
    variations_in: str
    balancing_in: str
    balancing_strategy_in: str
    variations_group_in: list[str]
    group_enabled_in: str | None = None
    before_cache: Callable[[], None] | None = None
    make: list[Stage] = field(default_factory=list)
    print_names: list[str] = field(default_factory=list)
    filled: bool = False

    def _names(self) -> list[str]:
        return [*self.split_names, *self.aggregate_names]

    def _printed(self, df: DataFrame, ctx: Context) -> DataFrame:
        """df with _source and _print."""
        made = {n for stage in self.make for n in stage.outputs()}
        read = [n for stage in self.make for n in stage.inputs()] + self.print_names + self._names()
        columns = [resolve(df, n) for n in dict.fromkeys(read) if n.split(".")[0] in df.columns or n.split(".")[0] not in made]
        # what a stage is: its fields, without the places of objects in memory
        stages = re.sub(r" at 0x[0-9a-f]+", "", repr((ctx.seed, [(type(x).__name__, x) for x in self.make], self._names())))
        digest = hashlib.sha256(stages.encode()).hexdigest()
        known = F.struct(*[F.xxhash64(F.lit(f"{k}{digest}"), *columns).alias(name) for k, name in enumerate("ab")])
        return df.withColumns({"_source": F.col("idx"), "_print": known})

    def _made(self, rows: DataFrame, ctx: Context, variation: int) -> DataFrame:
        made = rows.withColumn("variation", F.lit(variation))
        for stage in self.make:
            made = stage.apply(made, replace(ctx, variation=variation))
        return made.select("_source", "_print", *carried(made, self._names()))

    def _needed(self, df: DataFrame, ctx: Context) -> tuple[DataFrame, list[int]]:
        """The balanced rows with _source and _print, and the variations they take."""
        rows = expand(self._printed(df, ctx), ctx.variation, self.variations_group_in, self.balancing_in, self.balancing_strategy_in, self.group_enabled_in)
        wanted = rows.withColumn("in_variation", F.pmod("in_variation", resolve(rows, self.variations_in).cast("int")))
        return wanted, sorted(r[0] for r in wanted.select("in_variation").distinct().collect())

    def _folder(self, ctx: Context, variation: int) -> CacheFolder:
        return CacheFolder(ctx.spark, f"{self.cache_dir}/variation={variation}")

    def fill(self, df: DataFrame, ctx: Context) -> int:
        """Make what the epoch needs and the cache lacks; how many rows that were."""
        return sum(self._fill(df, ctx, v) for v in self._needed(df, ctx)[1])

    def _fill(self, df: DataFrame, ctx: Context, variation: int) -> int:
        rows = self._printed(df.filter(flag(df, self.group_enabled_in)), ctx)
        rows = rows.filter(resolve(rows, self.variations_in) > variation)
        folder, keys = self._folder(ctx, variation), ["_source", "_print"]
        schema = self._made(rows, ctx, variation).schema
        tables = folder.tables()
        missing = rows.join(folder.read(schema).select(*keys), keys, "left_anti") if tables else rows
        if missing.isEmpty():
            return 0
        if self.before_cache:
            self.before_cache()
        # a table's rows in files of bounded size, whatever the tasks before them were
        dealt = lambda made: made.repartition(F.expr(f"_source div {CACHED_ROWS}"))
        new = folder.write(dealt(self._made(missing, ctx, variation)))
        count = ctx.spark.read.parquet(f"{folder.path}/{new}").count()
        folder.replace([*tables, new])
        if len(tables) + 1 >= self.TABLES:
            live = folder.read(schema).join(rows.select(*keys), keys, "left_semi")
            folder.replace([folder.write(dealt(live))])
        return count

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        wanted, needed = self._needed(df, ctx)
        cached = None
        for v in needed:
            if not self.filled:
                self._fill(df, ctx, v)
            rows = self._printed(df, ctx)
            part = self._folder(ctx, v).read(self._made(rows, ctx, v).schema).withColumn("in_variation", F.lit(v))
            cached = part if cached is None else cached.union(part)
        if cached is None:
            cached = self._made(self._printed(df, ctx), ctx, 0).filter("false").withColumn("in_variation", F.lit(0))
        have = set(carried(cached, self._names()))
        kept = [c for c in wanted.columns if c not in have]
        out = wanted.select(*kept).join(cached, ["_source", "_print", "in_variation"])
        return out.select("variation", "idx", "in_variation", *carried(cached, self._names()))
