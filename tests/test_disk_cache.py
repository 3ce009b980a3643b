"""A cache that makes again what changed and nothing else."""

import os

import pytest
from pyspark.sql import functions as F

from samplemill.operators import balance
from samplemill.plans.stage import ColumnStage, Context


class Noted(ColumnStage):
    """value and variation as text; each row that is computed leaves a line in a file."""

    def __init__(self, log, mark="a"):
        self.log, self.mark, self.salt = log, mark, None

    def __repr__(self):
        return f"Noted({self.mark})"

    def inputs(self):
        return ["value"]

    def outputs(self):
        return ["made"]

    def columns(self, df, ctx):
        log, mark = self.log, self.mark

        @F.pandas_udf("string")
        def made(idx, value, variation):
            with open(log, "a") as f:
                f.write("".join(f"{v}:{i}\n" for i, v in zip(idx, variation, strict=True)))
            return mark + value.astype(str) + ":" + variation.astype(str)

        return {"made": made.asNondeterministic()(F.col("idx"), F.col("value"), F.col("variation"))}


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "cache"), str(tmp_path / "log")


def table(spark, values, **changed):
    rows = [(0, k, v, f"g{k % 2}", 2, 1.0, "REPEATS", "seen", 0) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "variation int, idx long, value long, g string, n int, b double, s string, other string, time long").withColumns({k: F.lit(v) for k, v in changed.items()})


def stage(place, **parameters):
    return balance.DiskCache(place[0], ["made"], ["value"], "n", "b", "s", ["g"], make=[Noted(place[1], parameters.pop("mark", "a"))], **parameters)


def epoch(spark, cache, df, variation, log):
    if os.path.exists(log):
        os.remove(log)
    rows = cache.apply(df, Context(spark, variation=variation)).orderBy("idx").collect()
    lines = sorted(set(open(log).read().split())) if os.path.exists(log) else []
    return [r["made"] for r in rows], lines


def test_only_changed_rows_are_made_again(spark, place):
    cache, log = stage(place), place[1]
    df = table(spark, range(10, 18))
    want = lambda values, v: sorted(f"a{x}:{v}" for x in values)
    got, made = epoch(spark, cache, df, 0, log)
    assert sorted(got) == want(range(10, 18), 0) and made == [f"0:{k}" for k in range(8)]
    assert epoch(spark, cache, df, 0, log)[1] == [] and epoch(spark, stage(place), df, 0, log)[1] == []
    got, made = epoch(spark, cache, df, 1, log)  # the second of two variations
    assert sorted(got) == want(range(10, 18), 1) and len(made) == 8 and made[0] == "1:0"
    assert epoch(spark, cache, df, 2, log)[1] == []  # the first one again
    values = [10, 11, 99, *range(13, 18)]
    got, made = epoch(spark, cache, table(spark, values), 0, log)
    assert sorted(got) == want(values, 0) and made == ["0:2"]
    assert epoch(spark, cache, table(spark, values, other="new"), 0, log)[1] == []  # what make doesn't read
    got, made = epoch(spark, cache, table(spark, [*values, 50]), 0, log)
    assert sorted(got) == want([*values, 50], 0) and made == ["0:8"]
    got, made = epoch(spark, cache, table(spark, values[:3]), 0, log)
    assert sorted(got) == want(values[:3], 0) and made == []
    got, made = epoch(spark, stage(place, mark="b"), df, 0, log)  # another stage
    assert got[0] == "b10:0" and len(made) == 8
    assert epoch(spark, cache, df, 0, log)[1] == []  # the first one's rows are still there


def test_what_a_column_points_to(spark, place):
    cache, log = stage(place, print_names=["time"]), place[1]
    assert len(epoch(spark, cache, table(spark, range(4)), 0, log)[1]) == 4
    assert len(epoch(spark, cache, table(spark, range(4), time=5), 0, log)[1]) == 4
    assert len(epoch(spark, stage(place), table(spark, range(4), time=6), 0, log)[1]) == 4 and epoch(spark, stage(place), table(spark, range(4), time=7), 0, log)[1] == []


def test_tables_are_put_together(spark, place):
    cache, log = stage(place), place[1]
    cache.TABLES = 3
    for k in range(5):
        values = [k, 1, 2, 3]
        got, made = epoch(spark, cache, table(spark, values), 0, log)
        assert sorted(got) == sorted(f"a{x}:0" for x in values) and len(made) == (4 if k == 0 else k != 1 or 1)
        folder = balance.CacheFolder(spark, f"{place[0]}/variation=0")
        assert len(folder.tables()) <= 2
    assert sum(n.startswith("rows-") for n in os.listdir(f"{place[0]}/variation=0")) <= 5
    # a filling that was broken off leaves tables that no list names
    folder.write(spark.range(3))
    assert epoch(spark, cache, table(spark, [4, 1, 2, 3]), 0, log)[1] == []


def test_filling_before(spark, place):
    called = []
    cache = stage(place, before_cache=lambda: called.append(1))
    df = table(spark, range(6))
    assert cache.fill(df, Context(spark, variation=0)) == 6 and cache.fill(df, Context(spark, variation=0)) == 0 and called == [1]
    read_only = stage(place, filled=True)
    got, made = epoch(spark, read_only, df, 0, place[1])
    assert len(got) == 6 and made == []
    assert stage(place).apply(df.filter("false"), Context(spark)).count() == 0
