import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplemill.functions import tensor as tn
from samplemill.functions import text as tx
from samplemill.operators import aspect, balance, geometry, models, order, paths, pixels, tags
from samplemill.plans.pipeline import Pipeline, resume_index
from samplemill.plans.stage import Context, UnknownName, resolve, shadow
from samplemill.sources import files, sinks


def apply(df, stage, variation=0):
    return stage.apply(df, Context(df.sparkSession, 42, variation))


def test_bucket_tables():
    assert len(aspect.buckets(512, 64)) == 15 and (512, 512) in aspect.buckets(512, 64)
    assert [len(aspect.buckets(*x)) for x in ((512, 8), (768, 64), (1024, 64))] == [17, 17, 17]


def test_paths_and_names(spark):
    import os.path

    found = ["/a/.hid", "b.tar.gz", "x/y.b/c", "..a.b", "/m/n.PNG", "a."]
    rows = spark.createDataFrame([(p,) for p in found], "p string").select("p", tx.stem(F.col("p")).alias("s")).collect()
    assert {r["p"]: r["s"] for r in rows} == {p: os.path.splitext(p)[0] for p in found}


def test_shadowing_falls_through_and_unknown_names_raise(spark):
    df = spark.createDataFrame([(0, 0, "old", None), (0, 1, "old", "new")], "variation int, idx long, a string, b string")
    assert [r["a"] for r in shadow(df, {"a": F.col("b")}).orderBy("idx").collect()] == ["old", "new"]
    with pytest.raises(UnknownName):
        resolve(df, "c.d")


def test_negative_keep_counts_slice_like_python(spark):
    items = ["a", "b", "c"]
    for k in (-5, -1, 0, 2, 9):
        df = spark.createDataFrame([(items, k)], "x array<string>, k int")
        head, rest = tx.head_and_rest(F.col("x"), F.col("k"))
        row = df.select(head.alias("h"), rest.alias("r")).first()
        assert (row["h"], row["r"]) == (items[:k], items[k:])


def test_tag_patterns_and_empty_replacement():
    assert tags.tag_patterns(["red", "b.*", "(bad"]) == (["red", "(bad"], ["b.*"])
    with pytest.raises(ValueError):
        tags.ReplaceText("a", "a", "", "x")


def test_unknown_strategy_raises(spark):
    df = spark.createDataFrame([(0, 0, "g", 1.0, "NO")], "variation int, idx long, g string, b double, s string")
    with pytest.raises(Exception, match="unknown balancing strategy"):
        apply(df, balance.VariationSorting(["g"], "b", "s", ["g"])).collect()


def test_balance_against_simulation(spark):
    rnd = random.Random(5)
    rows = [(0, i, rnd.choice("xyz"), 1.6, "REPEATS") for i in range(25)]
    df = spark.createDataFrame(rows, "variation int, idx long, g string, b double, s string").withColumn("key", F.col("idx"))
    for v in (0, 2):
        want, groups = [], {}
        for _, i, g, *_ in rows:
            groups.setdefault(g, []).append(i)
        for members in groups.values():
            n = int(len(members) * 1.6)
            want += [members[(k + v * n) % len(members)] for k in range(n)]
        got = apply(df, balance.VariationSorting(["key"], "b", "s", ["g"]), v).orderBy("idx").collect()
        assert [r["key"] for r in got] == want and [r["idx"] for r in got] == list(range(len(want)))


def test_batches_are_whole_and_of_one_bucket(spark):
    df = spark.range(101).select(F.lit(0).alias("variation"), F.col("id").alias("idx"), (F.col("id") % 3).alias("bucket"), F.col("id").alias("key"))
    for stage in (order.AspectBatchSorting("bucket", ["key", "bucket"], 4), order.InlineAspectBatchSorting("bucket", ["key", "bucket"], 4)):
        rows = apply(df, stage).orderBy("idx").collect()
        assert [r["idx"] for r in rows] == list(range(96)) and len({r["key"] for r in rows}) == 96
        assert all(len({r["bucket"] for r in rows[k : k + 4]}) == 1 for k in range(0, 96, 4))
        again = apply(df.repartition(7), stage).orderBy("idx").collect()
        assert again == rows


def test_resume_index():
    assert resume_index(10, 4) == 8


def test_geometry():
    a = np.arange(48, dtype=np.float32).reshape(3, 4, 4)
    assert np.allclose(geometry.resized(a, 4, 4), a) and geometry.resized(a, 2, 2).mean() == pytest.approx(a.mean())
    assert np.allclose(geometry.rotated(a, 0), a) and np.allclose(geometry.rotated(a, 90), np.rot90(a, axes=(1, 2)), atol=1e-3)
    x = np.random.default_rng(1).random((3, 5, 5)).astype(np.float32)
    assert np.allclose(geometry.hue_shifted(x, 0.0), x, atol=1e-5) and np.allclose(geometry.hue_shifted(x, 1.0), x, atol=1e-5)
    assert np.allclose(geometry.hue_shifted(x, 1 / 3), x[[2, 0, 1]], atol=1e-5)
    mask = np.zeros((1, 20, 20), np.float32)
    mask[0, 5:10, 6:12] = 1
    _, rows, columns = geometry.mask_window(mask, 0.0, [0.5] * 4, 8, (10, 20))
    assert rows[0] <= 5 and rows[1] >= 9 and columns[0] <= 6 and columns[1] >= 11


def test_flip_and_crop(spark):
    a = np.arange(12, dtype=np.float32).reshape(1, 3, 4)
    df = spark.createDataFrame([(0, 0, [1, 3, 4], a.ravel().tolist(), True)], "variation int, idx long, s array<int>, d array<float>, on boolean").withColumn("image", tn.tensor(F.col("s"), F.col("d"))).withColumn("size", F.array(F.lit(2), F.lit(2)))
    flipped = df.select(tn.flipped(F.col("image")).alias("image")).first()["image"]
    assert flipped["data"] == a[..., ::-1].ravel().tolist()
    row = apply(df, pixels.CropImage(["image"], "size")).first()["image"]
    assert row["shape"] == [1, 2, 2] and row["data"] == a[:, 0:2, 1:3].ravel().tolist()


def test_video_frames():
    assert files.frame_choice(10, 24, 3, 24, 0.0) == [1, 2, 3]
    assert files.frame_choice(2, 24, 4, 24, 0.0) == [1, 1, 1, 1]
    with pytest.raises(IndexError):
        files.frame_choice(0, 24, 1, 24, 0.5)


def test_files_to_batches_and_sinks(spark, tmp_path):
    for name in ("a", "_b", ".c"):
        (tmp_path / f"{name}.ppm").write_bytes(b"P6\n2 1\n255\n" + bytes(range(6)))
        (tmp_path / f"{name}.txt").write_text(f" one, two, {name} \nmore")
    (tmp_path / "a-masklabel.ppm").write_bytes(b"P6\n2 1\n255\n" + bytes(6))
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "z.ppm").write_bytes(b"")
    concepts = [{"name": "x", "path": str(tmp_path), "enabled": True, "below": True}, {"name": "y", "path": "/nowhere", "enabled": False}]
    stages = [
        files.CollectPaths("concept", "concept.path", "concept.below", "concept.enabled", "image_path", "concept", [".PPM"], None, ["-masklabel"]),
        [paths.ModifyPath("image_path", "text_path", "", ".txt"), None],
        files.LoadText("text_path", "prompt"),
        files.LoadImage("image_path", "image", -1.0, 1.0, [".ppm"]),
        sinks.SaveText("prompt", "image_path", str(tmp_path / "out")),
        paths.OutputColumns(["prompt", ("concept.name", "name"), "image"]),
    ]
    pipeline = Pipeline(spark, concepts, {"resolution": "512"}, stages, 2)
    rows = pipeline.epoch(0).orderBy("idx").collect()
    assert [r["prompt"] for r in rows] == ["one, two, .c", "one, two, _b", "one, two, a"] and [r["idx"] for r in rows] == [0, 1, 2]
    assert rows[0]["image"]["shape"] == [3, 1, 2] and rows[0]["image"]["data"][0] == pytest.approx(-1.0)
    assert (tmp_path / "out/epoch-0/2-a-prompt.txt").read_text() == "one, two, a"
    assert pipeline.batches(0).count() == 1 and pipeline.approximate_length() == 1


def test_stream_batches(spark, tmp_path):
    from samplemill.streaming.batches import stream_batches

    spark.range(50).select((F.col("id") % 3).alias("bucket"), F.col("id").alias("seq")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("bucket long, seq long").parquet(str(tmp_path / "in"))
    run = stream_batches(stream, "bucket", "seq", [], 4).writeStream.format("memory").queryName("batches").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    rows = spark.sql("select * from batches").collect()
    assert len(rows) == 48 and {r["pos"] for r in rows} == {0, 1, 2, 3}


def test_encoder_queries_take_all_tokens(spark, tmp_path):
    from samplemill import queries

    rows = [(1, " ".join(f"word{k}" for k in range(100))), (2, " ".join(f"other{k}" for k in range(30))), (3, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    given = {r["doc_id"]: (np.array(r["tokens"]), np.array(r["tokens_mask"])) for r in queries.tokenized(spark, str(tmp_path)).collect()}
    assert {d: (len(ids), mask.sum()) for d, (ids, mask) in given.items()} == {1: (77, 77), 2: (77, 30), 3: (77, 1)}

    def norm(x):
        return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)

    want = {
        "clip": lambda x, m: (77, norm(x[-2])),
        "t5": lambda x, m: (77, norm(x[-2])),
        "gemma": lambda x, m: (77, x[-1]),
        "llama": lambda x, m: (3, x[1:4, 1:]),
        "mistral": lambda x, m: (77, x[[1, 3]]),
        "qwen": lambda x, m: (75, (x[[1, 3]] * m[None, :, None])[:, 2:]),
        "ideogram": lambda x, m: (77, x[[1, 3]]),
        "anima": lambda x, m: (77, None),
    }
    for name, states in want.items():
        for r in queries.QUERIES[f"encode_{name}_text"](spark, str(tmp_path)).collect():
            ids, mask = given[r["doc_id"]]
            x = np.sin(np.outer(ids.astype(float) + 1, np.arange(1, 17))).astype(np.float32).reshape(77, 4, 4).transpose(1, 0, 2).astype(float)
            n, kept = states(x, mask)
            assert r["n"] == n and (kept is None or r["total"] == pytest.approx(kept.sum(), abs=2e-3)), name


def test_dense_index_with_many_partitions(spark):
    """Numbers are unique, dense, in order and the same on two runs, however many partitions there are."""
    from samplemill.functions.index import dense_index, number_block

    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority")
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("4", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        by = [F.col("o_orderdate"), F.col("o_orderkey")]
        for _ in range(2):
            found = dense_index(orders, by).toPandas().sort_values("idx")
            assert list(found["idx"]) == list(range(len(found))) and found.equals(found.sort_values(["o_orderdate", "o_orderkey"]))
            seen.append(found.reset_index(drop=True))
        assert seen[0].equals(seen[-1])
        grouped = dense_index(orders, [F.col("o_orderkey")], "at", ("o_orderpriority",), number_block(F.col("o_orderkey")), "n").toPandas()
        assert all(sorted(g["at"]) == list(range(len(g))) and set(g["n"]) == {len(g)} for _, g in grouped.groupby("o_orderpriority"))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert dense_index(orders.limit(0), by).count() == 0


def test_special_tags_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("red\nb.*\n")
    (tmp_path / "b.csv").write_text("green,1\nblue,2\n")
    text, csv = str(tmp_path / "a.txt"), str(tmp_path / "b.csv")
    rows = [(0, k, "first,red,green,bird,blue", True, 1.0, "FULL", "WHITELIST", ",", 1, s) for k, s in enumerate((text, csv, "green, bird", None))]
    df = spark.createDataFrame(rows, "variation int, idx long, text string, on boolean, p double, mode string, special string, d string, keep int, tags string")
    names = ("text", "on", "p", "mode", "special", "d", "keep", "out")
    drop = lambda **x: [r["out"] for r in apply(df, tags.DropTags(*names, **x)).orderBy("idx").collect()]
    assert set(drop(special_tags=text, regex_enabled=True)) == {"first, red, bird, blue"} and set(drop(special_tags=csv)) == {"first, green, blue"}
    assert drop(special_tags_in="tags", special_files=[text, csv]) == ["first, red", "first, green, blue", "first, green, bird", "first"]
    with pytest.raises(Exception, match="special_files"):
        drop(special_tags_in="tags")


def test_long_captions_take_linear_time(spark):
    import time

    took = []
    for n in (2_000, 32_000):
        df = spark.createDataFrame([(0, 0, " ".join(f"t{k}" for k in range(n)), True, 0.4, "RANDOM WEIGHTED", "WHITELIST", " ", 2)], "variation int, idx long, text string, on boolean, p double, mode string, special string, d string, keep int")
        began = time.time()
        out = apply(df, tags.DropTags("text", "on", "p", "mode", "special", "d", "keep", "out", special_tags=["t5"])).first()["out"]
        took.append(time.time() - began)
        assert out.startswith("t0  t1") and " t5 " in out
    assert took[1] < 16 * took[0] + 5


def test_names_are_checked_before_a_plan_is_built(spark):
    stages = [paths.MapData("concept.name", "x", lambda c: c), balance.VariationSorting(["x"], "concept.b", "concept.s", ["concept"])]
    Pipeline(spark, [{"name": "a", "b": 1.0, "s": "REPEATS"}], {}, [*stages, paths.OutputColumns(["x"])], 1)
    for more in (paths.MapData("concept.name", "y", lambda c: c), paths.SelectFirstInput(["x", "z"], "y")):
        with pytest.raises(UnknownName, match="no earlier stage"):
            Pipeline(spark, [{"name": "a"}], {}, [*stages, more], 1)


def test_plans_run_no_job(spark):
    from samplemill import queries

    tracker = spark.sparkContext.statusTracker()
    queries.caption_epoch(spark, "/root/testdata/sf0.001")  # reading schemas runs a job of its own
    before = len(tracker.getJobIdsForGroup(None))
    df = spark.range(10).select(F.lit(0).alias("variation"), F.col("id").alias("idx"), F.array(F.lit(300), F.lit(500)).alias("size"), F.lit("512").alias("target"))
    stages = [aspect.AspectBucketing(64, "size", "target", "scale", "crop"), order.AspectBatchSorting("crop", ["crop"], 2), order.InlineAspectBatchSorting("crop", ["crop"], 2)]
    for stage in stages:
        df = apply(df, stage)
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_hot_groups_spread(spark):
    from samplemill.functions import index

    rows = spark.range(300_000).select(F.lit(0).alias("variation"), F.col("id").alias("idx"), F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("g"), F.lit(1.5).alias("b"), F.lit("REPEATS").alias("s"), F.col("id").alias("key"))
    out = apply(rows, balance.VariationSorting(["key"], "b", "s", ["g"]))
    blocks = index.dense_index(rows, [F.col("idx")], "at", ("g",), index.number_block(F.col("idx"))).filter("g = 99").select(F.floor(F.col("idx") / index.BLOCK_ROWS)).distinct().count()
    assert blocks >= 4 and out.count() == sum(int(n * 1.5) for n in rows.groupBy("g").count().toPandas()["count"])


def test_png_and_orientation(spark, tmp_path):
    import struct
    import zlib

    rng = np.random.default_rng(3)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))

    def png(pixels, kind, filters, exif=None, palette=None):
        h, w, c = pixels.shape
        lines, flat = [], pixels.reshape(h, w * c).astype(np.int64)
        for y in range(h):
            left = np.concatenate([np.zeros(c, np.int64), flat[y][:-c]])
            up = flat[y - 1] if y else np.zeros(w * c, np.int64)
            corner = np.concatenate([np.zeros(c, np.int64), up[:-c]])
            p = left + up - corner
            paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            f = filters[y % len(filters)]
            lines.append(bytes([f]) + ((flat[y] - [0, left, up, (left + up) // 2, paeth][f]) % 256).astype(np.uint8).tobytes())
        extra = (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + (chunk(b"eXIf", exif) if exif else b"")
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")

    for kind, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        pixels = rng.integers(0, 256, (6, 5, channels), dtype=np.uint8)
        want = pixels[..., : channels - (kind in (4, 6))].transpose(2, 0, 1)
        assert np.array_equal(files.decode_png(png(pixels, kind, [0, 1, 2, 3, 4])), want)
    palette = rng.integers(0, 256, (9, 3), dtype=np.uint8)
    chosen = rng.integers(0, 9, (4, 4, 1), dtype=np.uint8)
    assert np.array_equal(files.decode_png(png(chosen, 3, [4, 1], palette=palette)), palette[chosen[..., 0]].transpose(2, 0, 1))
    a = np.arange(6, dtype=np.float32).reshape(1, 2, 3)
    want = {1: a, 2: a[..., ::-1], 3: np.rot90(a, 2, (1, 2)), 4: a[:, ::-1], 5: a.swapaxes(1, 2), 6: np.rot90(a, -1, (1, 2)), 7: np.rot90(a, 2, (1, 2)).swapaxes(1, 2), 8: np.rot90(a, 1, (1, 2))}
    assert all(np.array_equal(files.upright(a, k), w) for k, w in want.items())
    exif = b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, 6, 0, 0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif + b"\xff\xda"
    assert files.orientation(jpeg) == 6 and files.orientation(b"") == 1
    pixels = rng.integers(0, 256, (2, 3, 3), dtype=np.uint8)
    (tmp_path / "x.PNG").write_bytes(png(pixels, 2, [1], exif))
    df = spark.createDataFrame([(0, 0, str(tmp_path / "x.PNG")), (0, 1, str(tmp_path / "none.png"))], "variation int, idx long, path string")
    row, none = apply(df, files.LoadImage("path", "image", 0.0, 255.0, [".png"])).orderBy("idx").collect()
    seen = np.rot90(pixels.transpose(2, 0, 1), -1, (1, 2))
    assert none["image"] is None and row["image"]["shape"] == [3, 3, 2] and np.allclose(np.array(row["image"]["data"]).reshape(3, 3, 2), seen, atol=1e-4)
    depth = apply(df, models.GenerateDepth(None, "depth", models.HashPort(), path_in="path")).orderBy("idx").collect()
    low, high = seen.min(), seen.max()
    assert depth[1]["depth"] is None and np.allclose(depth[0]["depth"]["data"], (2 * (seen.astype(float) - low) / (high - low) - 1).ravel(), atol=1e-5)


def test_blank_latents_of_every_resolution(spark):
    class Port:
        def run(self, batch):  # a latent of half the size, mean and deviation
            return [np.concatenate([a[:, ::2, ::2] + 0.5, a[:, ::2, ::2]]) for a in batch]

    sizes = [(4, 4), (4, 6)]
    rows = [(0, k, [1, h // 2, w // 2], [0.0] * (h * w // 4), [3, h // 2, w // 2], [9.0] * (3 * h * w // 4)) for k in range(40) for h, w in sizes[k % 2 : k % 2 + 1]]
    df = spark.createDataFrame(rows, "variation int, idx long, ms array<int>, md array<float>, cs array<int>, cd array<float>").withColumns({"mask": tn.tensor(F.col("ms"), F.col("md")), "cond": tn.tensor(F.col("cs"), F.col("cd"))})
    got = apply(df, models.BlankLatents("mask", "cond", 0.5, Port(), sizes)).collect()
    blank = [r for r in got if r["cond"]["data"][0] == 0.5]
    assert 8 < len(blank) < 32 and all(set(r["mask"]["data"]) == {1.0} and r["cond"]["shape"] == r["cs"] for r in blank)
    assert all(set(r["mask"]["data"]) == {0.0} and r["cond"]["data"][0] == 9.0 for r in got if r not in blank)
    with pytest.raises(Exception, match="no possible resolution"):
        apply(df, models.BlankLatents("mask", "cond", 1.0, Port(), sizes[:1])).collect()
    assert apply(df, models.BlankLatents("mask", None, 1.0, Port())).first()["mask"]["data"][0] == 1.0
