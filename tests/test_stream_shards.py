"""Samplers and batches over streams that are stopped, killed and started again."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from samplemill.streaming.shards import stream_groups, stream_shards, use_state_store


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    use_state_store(spark)
    yield
    spark.conf.set(name, before)


def put(spark, folder, first, last):
    """Rows in a file of their own."""
    spark.range(first, last, numPartitions=1).select("id", (F.col("id") % 3).alias("bucket"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).write.mode("append").parquet(folder)


def opened(spark, folder):
    return spark.readStream.schema("id long, bucket long, text string").option("maxFilesPerTrigger", 1).parquet(folder)


def started(df, place):
    return df.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").start()


def test_a_sampler_that_is_killed_gives_each_row_once(spark, store, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path)
    for k in range(4):
        put(spark, folder, 40 * k, 40 * k + 40)
    shards = lambda: stream_shards(opened(spark, folder), "id", ["text"], 4, lanes=3)
    query = started(shards(), place)
    while query.lastProgress is None and query.isActive:
        time.sleep(0.1)
    query.stop()  # in the middle of whatever it does
    put(spark, folder, 160, 203)
    for _ in range(2):  # again, and once more without anything new
        query = started(shards(), place)
        query.processAllAvailable()
        query.stop()
    rows = spark.read.parquet(f"{place}/out").collect()
    ids = [r["id"] for r in rows]
    assert len(ids) == len(set(ids)) and 203 - 3 * 3 <= len(ids) <= 203 and all(r["text"] == f"t{r['id']}" for r in rows)
    ranks = Counter(r["rank"] for r in rows)
    assert set(ranks) == {0, 1, 2, 3} and len(set(ranks.values())) == 1
    assert set(Counter((r["lane"], r["round"]) for r in rows).values()) == {4}  # whole rounds only
    for lane in range(3):
        rounds = sorted({r["round"] for r in rows if r["lane"] == lane})
        assert rounds == list(range(len(rounds)))


def test_batches_whose_rows_wait_too_long(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, 0, 32)
    batches = stream_groups(opened(spark, folder), "bucket", "id", ["text"], 5, hold_ms=1500)
    query = batches.writeStream.format("memory").queryName("held").trigger(processingTime="300 milliseconds").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        until = time.time() + 90
        while spark.sql("select count(*) from held").first()[0] < 32 and time.time() < until:
            time.sleep(0.3)
    finally:
        query.stop()
    rows = spark.sql("select * from held").collect()
    assert sorted(r["id"] for r in rows) == list(range(32))
    sizes = Counter((r["bucket"], r["group"], r["whole"]) for r in rows)
    assert all(n == 5 for (_, _, whole), n in sizes.items() if whole) and sum(not whole for _, _, whole in sizes) == 2  # 11, 11 and 10 rows
    for r in rows:
        assert r["id"] == r["bucket"] + 3 * (5 * r["group"] + r["pos"])
