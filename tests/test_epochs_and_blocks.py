"""Epochs that are resumed from written files, and ports that are called with blocks."""

import re

import numpy as np
from pyspark.sql import functions as F

from samplemill.functions import tensor as tn
from samplemill.operators import models, order, paths
from samplemill.plans.epochs import WrittenEpoch
from samplemill.plans.pipeline import Pipeline
from samplemill.plans.stage import Context


def files_read(df):
    """Files that a plan's rows come from, and the filters on their folders."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df.select(F.input_file_name()).distinct().count(), re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]


def test_resuming_reads_only_what_is_left(spark, tmp_path):
    df = spark.range(1000).select(F.lit(0).alias("variation"), "id", (999 - F.col("id")).alias("idx")).repartition(7)
    epoch = WrittenEpoch.of(df, str(tmp_path / "e"), 100)
    assert epoch.blocks() == list(range(10))
    counts = []
    for first in (0, 250, 700, 999):
        left = epoch.since(first)
        count, filters = files_read(left)
        counts.append(count)
        assert "_block" in filters and left.count() == 1000 - first and left.agg(F.min("idx")).first()[0] == first
        assert [r["idx"] for r in epoch.iterate(first)] == list(range(first, 1000))
    assert counts == [10, 8, 3, 1]
    again = WrittenEpoch.of(spark.range(3).withColumn("idx", F.col("id")), str(tmp_path / "e"), 100)
    assert again.since(0).count() == 1000  # what is there whole isn't written again
    assert "Sort" not in epoch.since(500)._jdf.queryExecution().executedPlan().toString()
    none = WrittenEpoch.of(df.filter("false"), str(tmp_path / "none"), 100)
    assert none.blocks() == [] and list(none.iterate()) == [] and none.since(0).count() == 0 and none.since(0).columns == df.columns


def test_a_later_session_goes_on_with_the_same_rows(spark, tmp_path):
    given = spark.range(60).select(F.col("id").alias("idx"), F.struct(F.col("id").alias("n"), (F.col("id") % 3).alias("size")).alias("concept"))
    stages = [order.AspectBatchSorting("concept.size", ["concept"], 4, salt="s"), paths.OutputColumns([("concept.n", "n")])]
    whole = Pipeline(spark, given, {}, stages, 4, epochs_dir=str(tmp_path / "run"))
    rows = [(r["idx"], r["n"]) for r in whole.iterate(0)]
    assert [k for k, _ in rows] == list(range(60)) and rows != [(k, k) for k in range(60)]
    later = Pipeline(spark, given.limit(0), {}, stages, 4, initial_epoch_sample=22, epochs_dir=str(tmp_path / "run"))
    assert [(r["idx"], r["n"]) for r in later.iterate(0)] == rows[20:]
    assert [r["idx"] for r in Pipeline(spark, given, {}, stages, 4).iterate(1)] == list(range(60))


def of_one_shape():
    class OfOneShape:
        """A port that only takes blocks of one shape."""

        def run(self, batch, masks=None):
            assert len({np.asarray(a).shape for a in batch}) == 1
            return models.HashPort(factor=2.0).run(batch, masks)

    return OfOneShape()


def test_ports_get_blocks_of_one_shape(spark):
    assert list(models.blocks_of_one_shape([(2, 3), None, (4,), (2, 3), (2, 3)], 12)) == [[0, 3], [4], [2]] and list(models.blocks_of_one_shape([(9, 9)], 1)) == [[0]]
    rows = [(0, k, [1, 2, 2 + k % 3], [float(k)] * (2 * (2 + k % 3))) if k % 5 else (0, k, None, None) for k in range(40)]
    df = spark.createDataFrame(rows, "variation int, idx long, s array<int>, d array<float>").withColumn("image", F.when(F.col("s").isNotNull(), tn.tensor(F.col("s"), F.col("d"))))
    got = models.EncodeMoVQ("image", "out", of_one_shape()).apply(df, Context(spark)).orderBy("idx").collect()
    assert all((r["out"] is None) == (r["d"] is None) and (r["d"] is None or r["out"]["data"] == [2 * x for x in r["d"]] and r["out"]["shape"] == r["s"]) for r in got)
    texts = [(0, k, list(range(1 + k % 4)), [1] * (1 + k % 4)) for k in range(30)]
    df = spark.createDataFrame(texts, "variation int, idx long, tokens array<int>, mask array<int>")
    one = models.EncodeClipText("tokens", "mask", "state", of_one_shape(), -1, pooled_out="pooled").apply(df, Context(spark)).orderBy("idx").collect()
    two = models.EncodeClipText("tokens", "mask", "state", models.HashPort(), -1, pooled_out="pooled").apply(df, Context(spark)).orderBy("idx").collect()
    assert [(r["state"], r["pooled"]) for r in one] == [(r["state"], r["pooled"]) for r in two] and len(one[3]["state"]) == 4
