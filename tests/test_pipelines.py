"""Whole pipelines from files to batches: an inpainting set and a set of images alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplemill.operators import aspect, balance, geometry, models, order, paths, pixels, tags, tokens
from samplemill.plans.pipeline import Pipeline, collate, with_batches
from samplemill.sources import files, sinks


def shrink(deviation=False):
    class Shrink:
        """An encoder whose latent is the image at half its size, and a decoder that doubles it."""

        def __init__(self, deviation=False):
            self.deviation = deviation

        def run(self, batch):
            small = [a[..., ::2, ::2] for a in batch]
            return [np.concatenate([a, a * 0]) for a in small] if self.deviation else [a.repeat(2, -1).repeat(2, -2) for a in batch]

    return Shrink(deviation)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top, rng = tmp_path_factory.mktemp("images"), np.random.default_rng(6)
    for k in range(9):
        h, w = ((20, 20), (24, 12), (12, 24))[k % 3]
        place = top / ("sub" if k > 5 else "")
        place.mkdir(exist_ok=True)
        (place / f"i{k}.ppm").write_bytes(b"P6\n%d %d\n255\n" % (w, h) + rng.integers(0, 256, h * w * 3, dtype=np.uint8).tobytes())
        (place / f"i{k}.txt").write_text(f"first {k}, red, green, blue\nrest")
        if k % 2:
            mask = np.zeros((h, w), np.uint8)
            mask[4:10, 3:9] = 255
            (place / f"i{k}-masklabel.pgm").write_bytes(b"P5\n%d %d\n255\n" % (w, h) + mask.tobytes())
    return str(top)


def concepts(folder, **more):
    base = {"path": folder, "enabled": True, "below": True, "circular": True, "rotate": True, "flip": True, "fixed_flip": False, "jitter": None, "override": "16", "overridden": False, "shuffle": True, "delimiter": ",", "keep": 1, "variations": 2, "balancing": 1.5, "strategy": "REPEATS"}
    return [{"name": "A", **base, **more}, {"name": "B", "path": "/nowhere", "enabled": False}]


def collected(extension=".ppm"):
    return files.CollectPaths("concept", "concept.path", "concept.below", "concept.enabled", "image_path", "concept", [extension], None, ["-masklabel"])


def image_stages():
    return [
        collected(),
        files.LoadImage("image_path", "image", -1.0, 1.0, [".ppm"]),
        pixels.CalcAspect("image", "original"),
        aspect.AspectBucketing(8, "original", "settings.resolution", "scale", "crop", "concept.overridden", "concept.override"),
    ]


def test_inpainting_pipeline(spark, folder, tmp_path):
    """Images, masks, depth, captions and latents, cached and balanced, in whole batches of one resolution."""
    vocabulary, ports = tokens.HashVocabulary(1000), shrink(deviation=True)
    names = ["image", "mask", "depth"]
    split = ["latent", "latent_mask", "conditioning_latent", "latent_depth", "tokens"]
    before = [
        collected(),
        paths.ModifyPath("image_path", "mask_path", "-masklabel", ".pgm"),
        [paths.ModifyPath("image_path", "prompt_path", "", ".txt"), None],
        files.LoadImage("image_path", "image", -1.0, 1.0, [".ppm"]),
        pixels.GenerateImageLike("image", "mask", 255, 0.0, 1.0),
        files.LoadImage("mask_path", "mask", 0.0, 1.0, [".pgm"], channels=1),
        models.GenerateDepth(None, "depth", models.HashPort(), path_in="image_path"),
        files.LoadText("prompt_path", "prompt"),
    ]
    make = [
        pixels.RandomCircularMaskShrink("mask", "concept.circular", 1.0, 0.2, 1.0, salt="shrink"),
        geometry.RandomMaskRotateCrop("mask", ["image", "depth"], "concept.rotate", 8, 10, 30, 20, salt="rotate"),
        pixels.CalcAspect("image", "original"),
        aspect.AspectBucketing(8, "original", "settings.resolution", "scale", "crop", "concept.overridden", "concept.override", salt="aspect"),
        geometry.ScaleCropImage(names, "scale", "crop", "concept.jitter", "offset", salt="crop"),
        pixels.GenerateMaskedConditioningImage("image", "mask", "conditioning", 0.0, 1.0),
        pixels.RandomFlip([*names, "conditioning"], "concept.flip", "concept.fixed_flip", salt="flip"),
        models.EncodeVAE("image", "latent", ports),
        geometry.ScaleImage("mask", "latent_mask", 0.5),
        models.EncodeVAE("conditioning", "conditioning_latent", ports),
        geometry.ScaleImage("depth", "latent_depth", 0.5),
        tags.ShuffleTags("prompt", "concept.shuffle", "concept.delimiter", "concept.keep", "prompt", salt="shuffle"),
        tokens.Tokenize("prompt", "tokens", "tokens_mask", vocabulary, 8),
    ]
    resolutions = [(16, 16), (8, 16), (16, 8), (24, 16), (16, 24), (24, 24), (8, 24), (24, 8), (8, 8), (8, 32), (32, 8), (16, 32), (32, 16), (24, 32), (32, 24), (24, 40), (40, 24), (16, 40), (40, 16), (8, 40), (40, 8), (16, 48), (48, 16), (8, 48), (48, 8)]
    middle = balance.DiskCache(str(tmp_path / "cache"), split, ["crop", "image_path"], "concept.variations", "concept.balancing", "concept.strategy", ["concept.name"], make=make)
    after = [
        models.SampleVAEDistribution("latent", "latent_image", "mean"),
        models.SampleVAEDistribution("conditioning_latent", "latent_conditioning", "mean"),
        models.BlankLatents("latent_mask", "latent_conditioning", 0.3, ports, resolutions, salt="blank"),
        balance.Materialize(),
        order.AspectBatchSorting("crop", ["latent_image", "latent_conditioning", "latent_mask", "latent_depth", "tokens", "crop", "image_path"], 2, salt="batches"),
        paths.OutputColumns(["latent_image", "latent_conditioning", "latent_mask", "latent_depth", "tokens", "crop", "image_path"]),
    ]
    pipeline = Pipeline(spark, concepts(folder), {"resolution": "16, 24"}, [before, middle, after], 2, seed=42, initial_epoch_sample=3)
    for epoch in (0, 1):
        rows = pipeline.epoch(epoch).orderBy("idx").collect()
        first = 2 if epoch == 0 else 0
        assert [r["idx"] for r in rows] == list(range(first, first + len(rows))) and len(rows) % 2 == 0 and len(rows) >= 4
        assert all(rows[k]["crop"] == rows[k + 1]["crop"] for k in range(0, len(rows), 2))
        for r in rows:
            half = [s // 2 for s in r["crop"]]
            assert r["latent_image"]["shape"] == [3, *half] == r["latent_conditioning"]["shape"] and r["latent_mask"]["shape"] == [1, *half] and r["latent_depth"]["shape"] == [3, *half]
            assert all(len(r[n]["data"]) == np.prod(r[n]["shape"]) for n in ("latent_image", "latent_conditioning", "latent_mask", "latent_depth")) and len(r["tokens"]) == 8
    batches = collate(with_batches(pipeline.epoch(1), 2)).collect()
    assert len(batches) == len(rows) // 2 and all(len(b["tokens"]) == 2 for b in batches)
    assert sorted(p for b in batches for p in b["image_path"]) == sorted(r["image_path"] for r in rows)


def test_vae_pipeline(spark, folder, tmp_path):
    """Images to latents and back, saved; batches of four, resumed in the middle of an epoch."""
    stages = [
        image_stages(),
        geometry.ScaleCropImage(["image"], "scale", "crop", "concept.jitter", "offset"),
        pixels.RandomFlip(["image"], "concept.flip", "concept.fixed_flip"),
        models.EncodeVAE("image", "distribution", shrink(deviation=True)),
        balance.Materialize(),
        balance.RamCache(["distribution", "crop", "image_path"], "concept.balancing", "concept.strategy", ["concept.name"]),
        models.SampleVAEDistribution("distribution", "latent_image", "mean"),
        models.DecodeVAE("latent_image", "decoded", shrink()),
        sinks.SaveImage("decoded", "image_path", str(tmp_path / "debug"), -1.0, 1.0),
        order.AspectBatchSorting("crop", ["latent_image", "crop"], 4),
        paths.OutputColumns(["latent_image", "crop"]),
    ]
    pipeline = Pipeline(spark, concepts(folder, balancing=4.0), {"resolution": "16"}, stages, 4)
    rows = pipeline.epoch(0).orderBy("idx").collect()
    assert len(rows) >= 28 and all(len({str(r["crop"]) for r in rows[k : k + 4]}) == 1 for k in range(0, len(rows), 4))
    saved = sorted((tmp_path / "debug" / "epoch-0").glob("*.ppm"))
    assert len(saved) == 36 and files.decode_netpbm(saved[0].read_bytes()).shape[0] == 3
    assert pipeline.approximate_length() == len(rows) // 4
    held = pipeline.cached
    pipeline.epoch(1)
    assert held and not any(d.is_cached for d in held) and all(d.is_cached for d in pipeline.cached)
    later = Pipeline(spark, concepts(folder, balancing=4.0), {"resolution": "16"}, stages, 4, initial_epoch=1, initial_epoch_sample=10)
    assert later.epoch(1).agg(F.min("idx")).first()[0] == 8 and [e.agg(F.min("idx")).first()[0] for e in later.epochs(2)] == [8, 0]
    assert [r["idx"] for r in later.iterate(2)][:5] == [0, 1, 2, 3, 4]


def test_videos_and_fetched_datasets(spark, tmp_path):
    from samplemill.sources.concepts import FetchDatasets

    (tmp_path / "real").mkdir()
    np.save(tmp_path / "real" / "v.npy", np.arange(6 * 3 * 2 * 2, dtype=np.float32).reshape(6, 3, 2, 2))
    uri = "file://" + str(tmp_path / "real")

    def fetch(path):
        if path == "hub/name":
            return uri
        raise ValueError(path)

    given = [{"name": "a", "path": "hub/name", "enabled": True}, {"name": "b", "path": "hub/else", "enabled": False}]
    stages = [
        FetchDatasets(resolver=fetch),
        files.CollectPaths("concept", "concept.path", "concept.below", "concept.enabled", "path", "concept", [".npy"]),
        paths.MapData("path", "frames", lambda p: p.str.len() * 0 + 3, returns="int"),
        files.LoadVideo("path", "frames", "video", 0.0, 255.0, 24.0, [".npy"]),
        pixels.CalcAspect("video", "size"),
        paths.OutputColumns(["path", "video", "size"]),
    ]
    (row,) = Pipeline(spark, given, {}, stages, 1).epoch(0).collect()
    assert row["path"].startswith("file://") and row["video"]["shape"] == [3, 3, 2, 2] and row["size"] == [3, 2, 2]
    first = int(row["video"]["data"][0]) // 12
    want = np.arange(72).reshape(6, 3, 2, 2)[[min(first + k, 5) for k in range(3)]].transpose(1, 0, 2, 3)
    assert np.allclose(row["video"]["data"], want.ravel(), atol=1e-3)
