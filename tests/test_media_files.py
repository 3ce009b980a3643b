"""Image and video files against Java's own readers and writers, and against what was put in; parallel listing."""

import os
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplemill.plans.pipeline import Pipeline
from samplemill.plans.stage import Context
from samplemill.sources import files, jpeg, png, sinks, video


def picture(channels, h, w, seed=1):
    y, x = np.mgrid[:h, :w]
    base = np.stack([128 + 100 * np.sin(x / (3 + k) + y / (5 + k) + k) for k in range(channels)])
    return np.clip(base + np.random.default_rng(seed).normal(0, 12, (channels, h, w)), 0, 255).astype(np.uint8)


class Java:
    """ImageIO of the session's JVM."""

    def __init__(self, spark):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.jvm.java.lang.System.setProperty("java.awt.headless", "true")

    def ints(self, values):
        out = self.gateway.new_array(self.jvm.int, len(values))
        for k, v in enumerate(values):
            out[k] = int(v)
        return out

    def read(self, data, colours=False):
        """C x H x W of a file: samples of one band, else (or by choice) red, green and blue."""
        image = self.jvm.javax.imageio.ImageIO.read(self.jvm.java.io.ByteArrayInputStream(data))
        h, w, raster = image.getHeight(), image.getWidth(), image.getRaster()
        if raster.getNumBands() == 1 and not colours:
            return np.array(list(raster.getSamples(0, 0, w, h, 0, self.ints([0] * (w * h))))).reshape(1, h, w)
        flat = self.ints([0] * (w * h))
        image.getRGB(0, 0, w, h, flat, 0, w)
        a = np.array(list(flat), np.int64) & 0xFFFFFFFF
        return np.stack([a >> 16 & 255, a >> 8 & 255, a & 255]).reshape(3, h, w)

    def write_jpeg(self, a, progressive, quality):
        c, h, w = a.shape
        image = self.jvm.java.awt.image.BufferedImage(w, h, 1 if c == 3 else 10)
        if c == 3:
            image.setRGB(0, 0, w, h, self.ints((a[0].astype(int) << 16 | a[1].astype(int) << 8 | a[2]).ravel()), 0, w)
        else:
            image.getRaster().setSamples(0, 0, w, h, 0, self.ints(a.ravel()))
        io = self.jvm.javax.imageio
        writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
        wanted = writer.getDefaultWriteParam()
        wanted.setCompressionMode(2)
        wanted.setCompressionQuality(float(quality))
        if progressive:
            wanted.setProgressiveMode(1)
        out = self.jvm.java.io.ByteArrayOutputStream()
        stream = io.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, io.IIOImage(image, None, None), wanted)
        stream.flush()
        return bytes(out.toByteArray())


@pytest.fixture(scope="module")
def java(spark):
    return Java(spark)


@pytest.mark.parametrize("size", [(3, 37, 53), (3, 16, 16), (1, 30, 21), (3, 1, 1), (3, 9, 3), (3, 8, 17)])
def test_jpeg_pixels_are_those_of_another_decoder(java, size):
    a = picture(*size)
    made = [jpeg.encode_jpeg(a, q, smaller, restart) for q in (30, 92) for smaller in ((1, 1), (2, 1), (1, 2), (2, 2)) for restart in (0, 3)]
    made += [java.write_jpeg(a, progressive, q) for progressive in (False, True) for q in (0.2, 0.9)]
    assert b"\xff\xc2" in made[-1] and b"\xff\xc2" not in made[-3]
    for data in made:
        assert np.array_equal(jpeg.decode_jpeg(data), java.read(data))
    finest = jpeg.decode_jpeg(jpeg.encode_jpeg(a, 100, (1, 1)))
    assert np.abs(finest - a).max() <= 3


def rebuilt(data, kind, change):
    """The file with the contents of its segments of one kind changed."""
    out, at = [data[:2]], 2
    while data[at + 1] != 0xDA:
        n = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at : at + n]
        if part[1] == kind:
            new = change(part[4:])
            part = b"" if new is None else part[:2] + struct.pack(">H", len(new) + 2) + new
        out.append(part)
        at += n
    return b"".join(out) + data[at:]


def test_jpeg_of_odd_kinds():
    a = picture(3, 20, 24)
    data = jpeg.encode_jpeg(a, 90)
    want = jpeg.decode_jpeg(data)
    assert np.array_equal(jpeg.decode_jpeg(rebuilt(data, 0xC4, lambda d: None)), want)  # frames of moving pictures leave the tables out
    wide = rebuilt(data, 0xDB, lambda d: bytes([d[0] | 0x10]) + np.frombuffer(d[1:], np.uint8).astype(">u2").tobytes())
    assert np.array_equal(jpeg.decode_jpeg(wide), want)
    adobe = b"Adobe\0\x64\0\0\0\0"
    plain = jpeg.encode_jpeg(a, 100, (1, 1))
    planes = jpeg.decode_jpeg(rebuilt(plain, 0xE0, lambda d: None)[:2] + b"\xff\xee" + struct.pack(">H", 14) + adobe + b"\0" + rebuilt(plain, 0xE0, lambda d: None)[2:])
    assert np.array_equal(jpeg.coloured(*planes.astype(int)), jpeg.decode_jpeg(plain))  # said to be no colour differences
    for broken in (b"", b"\xff\xd8", data[:200], data[: len(data) // 2], data.replace(b"\xff\xc0", b"\xff\xc9"), rebuilt(data, 0xDB, lambda d: None), rebuilt(data, 0xC0, lambda d: d[:1] + bytes(4) + d[5:])):
        with pytest.raises(ValueError):
            jpeg.decode_jpeg(broken)
    with pytest.raises(ValueError):
        jpeg.encode_jpeg(np.zeros((2, 4, 4)))


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("channels", "depth"), [(1, 1), (1, 2), (1, 4), (1, 8), (1, 16), (2, 8), (2, 16), (3, 8), (3, 16), (4, 8), (4, 16)])
def test_png_round_trips(java, channels, depth, interlaced):
    rng = np.random.default_rng(channels * depth)
    for h, w in ((13, 9), (1, 1), (3, 5), (8, 8)):
        a = rng.integers(0, 1 << depth, (channels, h, w))
        data = png.encode_png(a, depth, interlaced=interlaced)
        seen = a[:1] if channels < 3 else a[:3]
        assert np.allclose(png.decode_png(data), seen * (255 / ((1 << depth) - 1)), atol=1e-3)
        if channels == 1 or (channels, depth) == (3, 8):
            assert np.array_equal(java.read(data), a)


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_palettes(java, depth):
    rng = np.random.default_rng(depth)
    palette, a = rng.integers(0, 256, (1 << depth, 3)), rng.integers(0, 1 << depth, (1, 11, 7))
    for interlaced in (False, True):
        data = png.encode_png(a, depth, palette, interlaced)
        assert np.array_equal(png.decode_png(data), palette[a[0]].transpose(2, 0, 1)) and np.array_equal(java.read(data, colours=True), png.decode_png(data))
    with pytest.raises(ValueError):
        png.decode_png(png.encode_png(np.full((1, 2, 2), (1 << depth) - 1), depth, palette[:1]))


def test_png_filters_and_faults():
    y, x = np.mgrid[:64, :64]
    smooth = np.stack([x * 2 + y, y * 3, x + y]) % 256
    data = png.encode_png(smooth)
    assert len(data) < smooth.size / 20 and np.array_equal(png.decode_png(data), smooth)
    for broken in (b"", png.SIGNATURE, data[:40], data.replace(b"IDAT", b"IDAX"), data[:33] + data[-12:]):
        with pytest.raises(ValueError):
            png.decode_png(broken)
    transparent = data[:33] + struct.pack(">I", 6) + b"tRNS" + bytes(6) + struct.pack(">I", zlib.crc32(b"tRNS" + bytes(6))) + data[33:]
    assert np.array_equal(png.decode_png(transparent), smooth)


def frame(spark, paths):
    return spark.createDataFrame([(0, k, p) for k, p in enumerate(paths)], "variation int, idx long, path string")


def test_images_are_loaded_turned_and_saved_in_their_format(spark, tmp_path):
    a = picture(3, 24, 16)
    exif = b"Exif\0\0II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, 6, 0, 0)
    data = jpeg.encode_jpeg(a, 95)
    (tmp_path / "turned.JPG").write_bytes(data[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + data[2:])
    (tmp_path / "named.png").write_bytes(data)  # a JPEG by its contents
    (tmp_path / "grey.jpeg").write_bytes(jpeg.encode_jpeg(a[:1], 95))
    (tmp_path / "deep.png").write_bytes(png.encode_png(a.astype(int) * 257, 16))
    (tmp_path / "bad.webp").write_bytes(b"RIFF")
    names = ["turned.JPG", "named.png", "grey.jpeg", "deep.png", "none.jpg"]
    df = frame(spark, [str(tmp_path / n) for n in names])
    stage = files.LoadImage("path", "image", 0.0, 255.0, [".jpg", ".jpeg", ".png"])
    ctx = Context(spark)
    loaded = stage.apply(df, ctx)
    rows = [r["image"] for r in loaded.orderBy("idx").collect()]
    seen = lambda r: np.array(r["data"]).reshape(r["shape"])
    want = jpeg.decode_jpeg(data)
    assert np.allclose(seen(rows[0]), np.rot90(want, -1, (1, 2)), atol=1e-4) and np.allclose(seen(rows[1]), want, atol=1e-4)
    assert np.allclose(seen(rows[2]), np.repeat(jpeg.decode_jpeg(jpeg.encode_jpeg(a[:1], 95)), 3, axis=0), atol=1e-4)
    assert np.allclose(seen(rows[3]), a, atol=1e-3) and rows[4] is None
    with pytest.raises(Exception, match="no known image format"):
        files.LoadImage("path", "image", 0.0, 1.0, [".webp"]).apply(frame(spark, [str(tmp_path / "bad.webp")]), ctx).collect()
    sinks.SaveImage("image", "path", str(tmp_path / "out"), 0.0, 255.0).apply(loaded, ctx)
    saved = sorted(os.listdir(tmp_path / "out/epoch-0"))
    assert saved == ["0-turned-image.jpg", "1-named-image.png", "2-grey-image.jpeg", "3-deep-image.png"]
    back = files.decode_image((tmp_path / "out/epoch-0/3-deep-image.png").read_bytes())
    assert np.array_equal(back, a) and (tmp_path / "out/epoch-0/0-turned-image.jpg").read_bytes()[:2] == b"\xff\xd8"
    sinks.SaveImage("image", "path", str(tmp_path / "own"), 0.0, 255.0, encoder=lambda x: b"%d" % x.shape[0], extension=".n").apply(loaded, ctx)
    assert (tmp_path / "own/epoch-0/1-named-image.n").read_bytes() == b"3"


def clip(n, h=12, w=20):
    return np.stack([picture(3, h, w, k) for k in range(n)])


def test_videos_by_frame(tmp_path):
    made = clip(7)
    decoded = np.stack([jpeg.decode_jpeg(jpeg.encode_jpeg(f, 95)) for f in made])
    for index in (True, False):
        data = video.encode_avi(made, 25, index=index)
        (tmp_path / "v.avi").write_bytes(data)
        v = video.open_video(str(tmp_path / "v.avi"))
        assert (v.count, v.rate) == (7, 25.0) and np.array_equal(v.frames([2, 3, 3, 6]), decoded[[2, 3, 3, 6]])
    absolute = video.encode_avi(made, 25)
    at, movie = absolute.index(b"idx1") + 8, absolute.index(b"movi")
    rows = b"".join(struct.pack("<4sIII", n, f, o + movie, s) for n, f, o, s in struct.iter_unpack("<4sIII", absolute[at:]))
    (tmp_path / "a.avi").write_bytes(absolute[:at] + rows)
    assert np.array_equal(video.open_video("file://" + str(tmp_path / "a.avi")).frames([6]), decoded[[6]])
    # a second part without index, and a frame without bytes that repeats the one before it
    more = video.encode_avi(made[:2], 25, index=False)
    movi = more[more.index(b"movi") - 8 :]
    empty = b"00dc" + bytes(4)
    inner = b"LIST" + struct.pack("<I", len(movi) - 8 + 8) + movi[8:] + empty
    (tmp_path / "x.avi").write_bytes(video.encode_avi(made, 25) + b"RIFF" + struct.pack("<I", len(inner) + 4) + b"AVIX" + inner)
    v = video.open_video(str(tmp_path / "x.avi"))
    assert v.count == 10 and np.array_equal(v.frames([7, 8, 9]), decoded[[0, 1, 1]])
    # plain frames, lines from below
    one = made[0]
    lines = b"".join(one[::-1, y].T.tobytes() for y in range(11, -1, -1))
    plain = video.Avi("", 1.0, [], 20, 12, 24, b"\0\0\0\0")
    assert np.array_equal(plain.frame(lines), one)
    with pytest.raises(ValueError):
        video.Avi("", 1.0, [], 20, 12, 24, b"H264").frame(b"\0\0\0\1")
    np.save(tmp_path / "v.npy", made)
    v = video.open_video(str(tmp_path / "v.npy"))
    assert v.count == 7 and np.array_equal(v.frames([5, 1]), made[[5, 1]])
    (tmp_path / "no").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        video.open_video(str(tmp_path / "no"))


def test_plain_frames_of_luminance_and_colour(tmp_path):
    grey = clip(5)[:, :1]
    data = video.encode_y4m(grey, 30)
    (tmp_path / "g.y4m").write_bytes(data)
    v = video.open_video(str(tmp_path / "g.y4m"))
    assert (v.count, v.rate) == (5, 30.0) and np.array_equal(v.frames([4, 0]), np.repeat(grey[[4, 0]], 3, axis=1))
    (tmp_path / "w.y4m").write_bytes(data.replace(b"FRAME\n", b"FRAME Ip\n"))
    v = video.open_video(str(tmp_path / "w.y4m"))
    assert v.count == 5 and np.array_equal(v.frames([3])[0, 0], grey[3, 0])
    for space, planes in ((b"420jpeg", 2 * 3 * 2), (b"422", 2 * 3 * 4), (b"444", 2 * 5 * 4)):
        body = bytes([16]) * 20 + bytes([128]) * planes
        light = bytes([235]) * 20 + bytes([128]) * planes
        (tmp_path / "c.y4m").write_bytes(b"YUV4MPEG2 W5 H4 F30000:1001 C" + space + b"\nFRAME\n" + body + b"FRAME\n" + light)
        v = video.open_video(str(tmp_path / "c.y4m"))
        assert v.count == 2 and v.frames([0]).max() == 0 and v.frames([1]).min() == 255 and 29 < v.rate < 30
    red = bytes([81]) * 4 + bytes([90]) + bytes([240])
    (tmp_path / "r.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F25:1\nFRAME\n" + red)
    assert np.abs(video.open_video(str(tmp_path / "r.y4m")).frames([0])[0, :, 0, 0] - [255, 0, 0]).max() <= 2


def test_load_video_reads_the_chosen_frames(spark, tmp_path):
    made = clip(9)
    (tmp_path / "v.avi").write_bytes(video.encode_avi(made, 24))
    (tmp_path / "v.y4m").write_bytes(video.encode_y4m(made[:, :1], 24))
    df = frame(spark, [str(tmp_path / n) for n in ("v.avi", "v.y4m", "none.avi", "other.mkv")]).withColumn("n", F.lit(3))
    stage = files.LoadVideo("path", "n", "video", 0.0, 255.0, 24.0, [".avi", ".y4m"], salt="clip")
    rows = stage.apply(df, Context(spark)).withColumn("u", stage.random(Context(spark))).orderBy("idx").collect()
    decoded = np.stack([jpeg.decode_jpeg(jpeg.encode_jpeg(f, 95)) for f in made])
    for r, frames in zip(rows[:2], (decoded, np.repeat(made[:, :1], 3, axis=1)), strict=True):
        want = frames[files.frame_choice(9, 24.0, 3, 24.0, r["u"])].transpose(1, 0, 2, 3)
        assert r["video"]["shape"] == [3, 3, 12, 20] and np.allclose(r["video"]["data"], want.ravel(), atol=1e-3)
    assert rows[2]["video"] is None and rows[3]["video"] is None


def test_listing_of_many_files_below_one_concept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PAGE", 700)
    for k in range(100):
        inner = tmp_path / "all" / f"d{k % 10}" / f"e{k}"
        inner.mkdir(parents=True)
        for j in range(1000):
            os.close(os.open(inner / f"f{j}.PNG", os.O_CREAT))
    (tmp_path / "all" / ".no").mkdir()
    (tmp_path / "all" / ".no" / "x.png").write_bytes(b"")
    (tmp_path / "all" / "top.png").write_bytes(b"")
    given = [{"path": str(tmp_path / "all"), "enabled": True, "below": True}, {"path": str(tmp_path / "all"), "enabled": True, "below": False}, {"path": "/nowhere", "enabled": False, "below": True}]
    stage = files.CollectPaths("concept", "concept.path", "concept.below", "concept.enabled", "path", "concept", [".png"])
    rows = Pipeline(spark, given, {}, [stage], 1).epoch(0).select("idx", "path", F.col("concept.below").alias("below")).toPandas().sort_values("idx")
    want = sorted([str(tmp_path / "all" / "top.png"), *(str(tmp_path / "all" / f"d{k % 10}" / f"e{k}" / f"f{j}.PNG") for k in range(100) for j in range(1000))])
    assert rows["path"].tolist() == [*want, str(tmp_path / "all" / "top.png")] and rows["idx"].tolist() == list(range(100_002))
    # the hundred folders of the last level are dealt to all tasks
    folders = spark.createDataFrame([(0, str(tmp_path / "all" / f"d{k % 10}" / f"e{k}")) for k in range(100)], "_concept long, _path string")
    spread = files.listed(folders, True).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(spread) >= 3 and spread.max() < 60_000
    assert files.listed_below(folders.limit(0)).count() == 0


def test_orientation_and_pages_of_a_folder(tmp_path):
    from samplemill.functions.stores import list_folder

    for k in range(5):
        (tmp_path / f"f{k}").write_bytes(b"")
        (tmp_path / f"d{k}").mkdir()
    (tmp_path / ".hidden").mkdir()
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        pages = list(list_folder(folder, 3))
        assert len(pages) >= 3 and all(len(a) + len(b) <= 3 for a, b in pages)
        found, folders = sorted(p for a, _ in pages for p in a), sorted(p for _, b in pages for p in b)
        assert [re.sub(r".*/", "", p) for p in found] == [f"f{k}" for k in range(5)] and [re.sub(r".*/", "", p) for p in folders] == [f"d{k}" for k in range(5)]
        assert all(p.startswith(folder) for p in found)


def test_loaded_images_go_on_in_pieces_of_bounded_size(spark, tmp_path):
    """The names of 401 files are one Arrow batch; what a worker holds doesn't grow with their images, 400 MB."""
    (tmp_path / "a.n").write_bytes(b"")

    def large(data):
        with open("/proc/self/statm") as f:
            return np.full((1, 512, 512), int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20, np.float32)

    df = spark.range(0, 401, 1, 1).selectExpr("0 AS variation", "id AS idx", f"concat('{tmp_path}/', if(id = 200, 'none', 'a'), '.n') AS path")
    loaded = files.LoadImage("path", "image", 0.0, 255.0, [".n"], channels=1, decoders={".n": large}).apply(df, Context(spark))
    rows = loaded.select("idx", F.get("image.data", F.lit(7)).alias("mb"), F.size("image.data").alias("n"), "image.shape").collect()
    assert [r["idx"] for r in rows] == list(range(401)) and [r["idx"] for r in rows if r["shape"] is None] == [200]
    assert all(r["n"] == 1 << 18 and r["shape"] == [1, 512, 512] for r in rows if r["idx"] != 200)
    held = [r["mb"] for r in rows if r["idx"] != 200]
    assert max(held) - min(held) < 150


def test_saved_images_come_in_batches_of_bounded_size(spark, tmp_path):
    import sys

    df = spark.range(0, 40, 1, 1).selectExpr("0 AS variation", "id AS idx", "id || '.x' AS path", "struct(array(1, 512, 512) AS shape, array_repeat(float(id), 512 * 512) AS data) AS image")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    # the encoder's caller holds the batch
    sinks.SaveImage("image", "path", str(tmp_path), 0.0, 1.0, encoder=lambda a: b"%d %d" % (a[0, 9, 9], len(sys._getframe(1).f_locals["batch"])), extension=".n").apply(df, Context(spark))
    found = [(tmp_path / f"epoch-0/{k}-{k}-image.n").read_bytes().split() for k in range(40)]
    assert [int(k) for k, _ in found] == list(range(40)) and max(int(n) for _, n in found) <= 10
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
