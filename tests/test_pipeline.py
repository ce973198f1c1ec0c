"""From synthetic frames to mosaics; sinks; streaming; manual attachment."""

from __future__ import annotations

import io
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from petroloom.functions import blend
from petroloom.functions.fov import FieldOfView
from petroloom.plans import keyframes as kf, merge, mosaic, pipeline
from petroloom.settings import Settings
from petroloom.sources import images, mosaic_file, synthetic, tiff

FOV = FieldOfView(160.3, 119.1, 105, 320, 240)
SETTINGS = Settings(analysis_fps=30.0, tile_size=256, work_diameter=320, coarse_diameter=128)


def error(poses, truth):
    """Root mean square and largest distance after the best rigid fit."""
    a, b = poses - poses.mean(axis=0), truth - truth.mean(axis=0)
    t = math.atan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(), (a * b).sum())
    c, s = math.cos(t), math.sin(t)
    d = np.linalg.norm(a @ np.array([[c, s], [-s, c]]) - b, axis=1)
    return float(np.sqrt((d**2).mean())), float(d.max())


@pytest.fixture(scope="module")
def video(spark):
    img = synthetic.specimen(700, 480, 2, 250)
    at = synthetic.snake(140, 480, 140, 2, 110, 16.3)
    frames = [synthetic.view(img, FOV, x, y, seed=k, vignette=0.2) for k, (x, y) in enumerate(at)]
    return images.from_arrays(spark, frames).repartition(3), at


@pytest.fixture(scope="module")
def result(video, tmp_path_factory):
    frames, _ = video
    return pipeline.run(frames, str(tmp_path_factory.mktemp("out")), SETTINGS)


def test_field_of_view_of_frames(video):
    got = pipeline.detect_fov(video[0])
    assert np.hypot(got.cx - FOV.cx, got.cy - FOV.cy) < 2.5 and abs(got.radius - FOV.radius) < 3


def test_positions(video, result):
    truth = video[1][result.keyframes["frame_index"].to_numpy(int)]
    assert (result.component == 0).all()
    rms, most = error(result.poses[:, :2], truth)
    assert rms < 0.5 and most < 1.5


def test_files(result):
    data = open(f"{result.out}/mosaic.tif", "rb").read()
    pixels = tiff.read(data)
    assert pixels.shape[1::-1] == result.mosaics[0]["size"]
    assert (pixels.sum(axis=2) > 0).mean() > 0.5
    assert open(f"{result.out}/preview.jpg", "rb").read(2) == b"\xff\xd8"
    assert open(f"{result.out}/fov.jpg", "rb").read(2) == b"\xff\xd8"
    report = pd.read_csv(f"{result.out}/frame_positions.csv")
    assert list(report.columns) == pipeline.POSITIONS and (report["status"] == "used").all() and report["x"].min() > 0
    assert list(pd.read_csv(f"{result.out}/segment_links.csv").columns) == pipeline.LINKS


def test_link_previews(spark, result, tmp_path):
    records = pd.DataFrame({"attempt": [1], "main_kf": [0], "seg_kf": [1], "status": ["accepted"], "dx": [20.0], "dy": [0.0], "phi": [0.0]})
    pipeline.previews(records, spark.read.parquet(f"{result.out}/merge/crops.parquet"), FOV, str(tmp_path))
    assert open(tmp_path / records["preview"][0], "rb").read(2) == b"\xff\xd8"


def test_confirming_round(spark, result, monkeypatch):
    session, far, near = merge.MergeSession(spark, result.out), [], []
    session.table.loc[len(session.table) // 2 :, "component"] = 1
    session.settings = SETTINGS.replace(link_tolerance=0.05)
    pairs, local = session.pairs, merge.SparkMatcher.local
    monkeypatch.setattr(session, "pairs", lambda c, t, d: far.append(d) or pairs(c, t, d))
    monkeypatch.setattr(merge.SparkMatcher, "local", lambda self, p, r: near.append(r) or local(self, p, r))
    found = session.refine(1, (0.0, 0.0, 0.0), 0.2)
    assert found.confirmed and far == pytest.approx([1.05 * session.fov.diameter, 0.85 * session.fov.diameter]) and near == [0.2, 0.05]


def test_a_failure_leaves_nothing_behind(spark, result, monkeypatch):
    session = merge.MergeSession(spark, result.out)
    session.table.loc[len(session.table) // 2 :, "component"] = 1
    before = sorted(os.listdir(result.out))

    def broken(tiles, path, settings, preview):
        open(path, "wb").close()
        raise OSError("disk full")

    monkeypatch.setattr(merge.pipeline.mosaic, "save", broken)
    with pytest.raises(OSError):
        session.merge(1, (0.0, 0.0, 0.0))
    assert sorted(os.listdir(result.out)) == before and session.unlinked() == [1]


def test_attaching_by_hand(spark, result):
    """Cuts the result's graph in two by its state and puts it together again."""
    session = merge.MergeSession(spark, result.out)
    n = len(session.table)
    session.table.loc[n // 2 :, "component"] = 1
    turned = (30.0, -12.0, math.radians(1.0))
    mine = session.table["component"] == 1
    session.table.loc[mine, ["x", "y"]] = merge.apply(turned, session.table.loc[mine, ["x", "y"]].to_numpy())
    session.table.loc[mine, "theta"] += turned[2]
    session.state["frames"] = session.table.to_dict(orient="records")
    assert session.unlinked() == [1] and session.status(1) == "unlinked"
    c, s = math.cos(turned[2]), math.sin(turned[2])
    back = (-(c * 30.0 + s * -12.0), -(-s * 30.0 + c * -12.0), -turned[2])
    session.settings = SETTINGS.replace(max_rotation_deg=3.0)
    start = (back[0] + 0.06 * FOV.diameter, back[1] - 0.04 * FOV.diameter, back[2] + math.radians(0.5))
    found = session.refine(1, start, 0.2)
    got = found.transform
    assert found.confirmed and 2 <= found.consistent <= found.matched <= found.tested and found.message == "confirmed"
    assert found.pairs["consistent"].sum() == found.consistent and found.rms < 3 and found.quality > 0.5 and found.moved > 5
    away = session.refine(1, (9e5, 0.0, 0.0), 0.2)
    assert not away.confirmed and away.tested == 0 and "overlap" in away.message
    centre = session.table.loc[mine, ["x", "y"]].to_numpy().mean(axis=0)
    assert np.hypot(*(merge.apply(got, centre) - merge.apply(back, centre))) < 1.0
    before = open(f"{result.out}/mosaic.tif", "rb").read()
    session.merge(1, got)
    assert open(f"{result.out}/mosaic.tif", "rb").read() == before and os.path.exists(f"{result.out}/mosaic_merged.tif")
    assert session.preview_scale() <= 1 and len(session.frame_info(0)) == (session.table["component"] == 0).sum()
    again = merge.MergeSession(spark, result.out)
    assert again.unlinked() == [] and again.status(1) == "merged"
    report = pd.read_csv(f"{result.out}/frame_positions_merged.csv")
    assert set(report["status"]) == {"used", "merged"}
    with pytest.raises(ValueError):
        again.merge(1, got)


def test_pictures():
    from petroloom.functions import draw

    img = synthetic.specimen(400, 300, 3, 80)
    a, b = (synthetic.view(img, FOV, x, 150, noise=0) for x in (190, 210))
    out = draw.overlay(FOV.crop(a), FOV.crop(b), FOV, 20.0, 0.0, 0.0)
    inner = out[80:120, 90:120].astype(int)
    assert np.abs(inner[..., 0] - inner[..., 1]).mean() < 8
    assert (draw.field_of_view(a, FOV) == (0, 255, 0)).all(axis=2).any()


def test_points():
    t = (120.0, -40.0, math.radians(2.0))
    u = np.array([(0, 0), (500, 30), (100, 400)], float)
    got, rms = merge.from_points(list(zip(u, merge.apply(t, u))))
    assert np.allclose(got, t, atol=1e-9) and rms < 1e-9
    assert merge.from_points([((1, 2), (4, 6))])[0] == (3.0, 4.0, 0.0)


def test_tracker_loses_and_starts_again():
    img = synthetic.specimen(700, 480, 4, 250)
    other = synthetic.specimen(700, 480, 5, 250)
    tracker = kf.Tracker(kf.Registrar(FOV, SETTINGS))
    places = [(200 + 15 * k, 200) for k in range(6)]
    out = [e for k, (x, y) in enumerate(places) for e in tracker.step(k, k / 30, FOV.crop(synthetic.view(img, FOV, x, y, seed=k)))]
    assert [e["event"] for e in out][:3] == ["keyframe", "edge", "keyframe"] and tracker.segment == 0
    for k in range(6, 10):
        out = tracker.step(k, k / 30, FOV.crop(synthetic.view(other, FOV, 300, 200 + k, seed=k)))
    assert tracker.segment == 1 and tracker.stats.failed == 3


@pytest.mark.parametrize("blending", ["none", "feather", "multiband"])
def test_blending_keeps_a_flat_image(blending):
    img, weight = np.full((64, 64, 3), 100.0, np.float32), np.zeros((64, 64), np.float32)
    left, right = weight.copy(), weight.copy()
    left[:, :40], right[:, 24:60] = 0.5, 0.6
    layers = [(img * (left > 0)[..., None], left), (img * (right > 0)[..., None], right)]
    out = blend.multiband(layers, 3) if blending == "multiband" else blend.simple(layers, None if blending == "none" else 1.5)
    assert np.abs(out[:, :60].astype(int) - 100).max() <= 2 and not out[:, 60:].any()


def test_flat_field():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:40, :40]
    light = 1 - 0.4 * ((x - 20) ** 2 + (y - 20) ** 2) / 800
    mask = (x - 20) ** 2 + (y - 20) ** 2 < 380
    thumbs = [np.clip(rng.uniform(100, 200, (40, 40, 3)) * light[..., None], 0, 255).astype(np.uint8) for _ in range(60)]
    gain = blend.flat_field(thumbs, mask)
    even = (gain * light[..., None])[mask]
    assert even.std() / even.mean() < 0.05 and blend.flat_field(thumbs[:5], mask) is None


def test_flat_field_of_all_kept_keyframes(spark):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:24, :30]
    mask = (x - 15) ** 2 + (y - 12) ** 2 < 130
    light = 1 - 0.4 * ((x - 15) ** 2 + (y - 12) ** 2) / 300
    imgs = [np.full((24, 30, 3), 3, np.uint8)] * 400 + [np.clip(rng.uniform(100, 200, (24, 30, 3)) * light[..., None], 0, 255).astype(np.uint8) for _ in range(300)]
    crops = spark.createDataFrame([(k, 30, 24, bytearray(i.tobytes())) for k, i in enumerate(imgs)], "id long, width int, height int, data binary").repartition(3)
    gain = pipeline.flat_field(crops, list(range(700)), mask, 25.0)
    assert gain is not None and np.array_equal(gain, blend.flat_field(imgs, mask))
    assert np.array_equal(pipeline.flat_field(crops, list(range(390, 700)), mask, 25.0), blend.flat_field(imgs[390:], mask))
    assert pipeline.flat_field(crops, list(range(400)), mask, 25.0) is None  # the beginning alone gives nothing


@pytest.mark.parametrize("big", [False, True])
def test_tiff(big):
    img = np.random.default_rng(1).integers(0, 256, (70, 100, 3)).astype(np.uint8)
    tiles = []
    for k in range(6):
        t = np.zeros((32, 32, 3), np.uint8)
        part = img[k // 4 * 32 : k // 4 * 32 + 32, k % 4 * 32 : k % 4 * 32 + 32]
        t[: part.shape[0], : part.shape[1]] = part
        tiles.append((k, tiff.packed(t)))
    out = io.BytesIO()
    tiff.write(out, 100, 70, tiles[::-1], 32, True, big)
    back = tiff.read(out.getvalue())
    assert (back[:32] == img[:32]).all() and (back[32:64, :64] == img[32:64, :64]).all() and not back[64:].any()


@pytest.mark.parametrize(("size", "gone", "big"), [((2300, 1500), (0, 3, 40), False), ((2300, 1500), (), True), ((250, 200), (), False), ((250, 200), (), True), ((700, 300), range(6), False)])
def test_tiles_written_by_tasks(spark, tmp_path, size, gone, big, monkeypatch):
    """The bytes are those of one writer that takes the tiles in order; several runs of numbers in the first case."""
    monkeypatch.setattr(mosaic_file, "RUN", 16)
    rng = np.random.default_rng(5)
    count = -(-size[0] // 256) * -(-size[1] // 256)
    tiles = [(k, tiff.packed(np.repeat(rng.integers(0, 256, (256, 64, 3)), 4, axis=1).astype(np.uint8))) for k in range(count) if k not in gone]
    want = io.BytesIO()
    tiff.write(want, *size, tiles, 256, True, big)
    df = spark.createDataFrame([(k, bytearray(t)) for k, t in tiles[::-1]], "number long, data binary").repartition(3)
    mosaic_file.write(df, str(tmp_path / "m.tif"), *size, 256, True, big)
    assert (tmp_path / "m.tif").read_bytes() == want.getvalue() and os.listdir(tmp_path) == ["m.tif"]
    assert tiff.read(want.getvalue()).shape == (size[1], size[0], 3)


def test_failed_tile_leaves_no_file(spark, tmp_path):
    (tmp_path / "m.tif").write_bytes(b"before")
    data = spark.range(4).withColumnRenamed("id", "number")
    torn = data.withColumn("data", F.expr("if(number = 2, cast(raise_error('torn') as binary), cast('abc' as binary))"))
    placed = data.select("number", (8 + 3 * F.col("number")).alias("at"), F.lit(3).cast("long").alias("size")).join(torn, "number")
    spark.dataSource.register(mosaic_file.MosaicFile)
    options = {"path": str(tmp_path / "m.tif"), "width": 512, "height": 512, "tile": 256, "compress": 1, "big": 0, "end": 20, "blank": 0}
    for bad in (placed, placed.withColumn("data", F.lit(b"abcd")), placed.filter("number < 3").withColumn("data", F.lit(b"abc"))):
        with pytest.raises(Exception, match="torn|another size|tiles are missing"):
            bad.write.format("mosaic_file").mode("append").options(**options).save()
        assert os.listdir(tmp_path) == ["m.tif"] and (tmp_path / "m.tif").read_bytes() == b"before"


def test_image_sequence(spark, tmp_path):
    """Frames are numbered by name; what is no image is left out; a rate without sense is 30."""
    rng = np.random.default_rng(3)
    want = [np.repeat(np.repeat(rng.integers(0, 256, (3, 4, 3)), 8, 0), 8, 1).astype(np.uint8) for _ in range(5)]
    for k, img in enumerate(want):
        mosaic.jpeg(spark, img, str(tmp_path / f"f{k:03}.jpg"), 100)
    (tmp_path / "f002a.jpg").write_bytes(b"no image")
    got = images.image_sequence(spark, str(tmp_path), "v", fps=float("nan")).orderBy("frame_index").collect()
    assert [(r["video_id"], r["frame_index"], r["width"], r["height"]) for r in got] == [("v", k, 32, 24) for k in range(5)]
    assert [r["time_s"] for r in got] == [k / 30 for k in range(5)]
    for r, img in zip(got, want, strict=True):
        assert np.abs(kf.image(r["data"], 32, 24).astype(int) - img).mean() < 8  # JPEG


def test_streams(spark, sf, tmp_path):
    """Two batches, the second also with frames that were read before: those are late."""
    from petroloom.catalog import stream
    from petroloom.operators import tracking
    from petroloom.streaming import keyframes as sk

    frames = stream(spark, sf).select("user_id", "frame_index", "value")
    want = {tuple(r) for r in tracking.keyframe_gate(frames, "user_id", "value", 40.0).collect()}
    source = str(tmp_path / "in")

    def read() -> None:
        live = spark.readStream.schema(frames.schema).parquet(source)
        out = sk.gate(live, "user_id", "value", 40.0).writeStream.format("parquet").outputMode("append")
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)

    frames.filter("frame_index < 3").coalesce(1).write.parquet(source)
    read()
    frames.filter("frame_index >= 1").coalesce(1).write.mode("append").parquet(source)
    read()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["user_id"], r["frame_index"]) for r in rows} == want and len(rows) == len(want)
    assert max(r["late"] for r in rows) == 2


def test_stream_of_frames(spark, video, tmp_path):
    from petroloom import schema
    from petroloom.streaming import keyframes as sk

    frames, _ = video
    want = {(r["frame_index"], r["segment"]) for r in kf.select(frames, FOV, SETTINGS).filter("event = 'keyframe'").collect()}
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema.FRAMES).parquet(str(tmp_path / "in"))
    q = sk.track(live, FOV, SETTINGS).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = {(r["frame_index"], r["segment"]) for r in spark.table("tracked").filter("event = 'keyframe'").collect()}
    assert got == want


def test_command_line():
    from petroloom import cli

    args = cli.parser().parse_args(["x", "--tile-size", "512", "--flat-field", "false"])
    s = cli.settings(args)
    assert s.tile_size == 512 and s.flat_field is False


def test_cached_crops_go_or_stay(spark, tmp_path):
    import os

    from petroloom.plans import pipeline
    from petroloom.settings import Settings

    crops = spark.createDataFrame([(1, 2, 2, bytearray(12))], "id long, width int, height int, data binary")
    read, at = pipeline.cached(crops, Settings(cache_dir=str(tmp_path)))
    assert at.startswith(str(tmp_path)) and read.count() == 1
    pipeline.dropped(spark, at)
    assert not os.path.exists(at)


def test_samples_are_screened_against_all_main_frames(spark):
    from petroloom.functions.fov import FieldOfView
    from petroloom.plans.matching import SparkMatcher
    from petroloom.settings import Settings
    from petroloom.sources import synthetic

    img, fov = synthetic.specimen(500, 400, 1, 150), FieldOfView(120.3, 90.1, 80, 240, 180)
    places = [(200, 180), (212, 186), (225, 178), (300, 240), (206, 190)]
    views = [np.ascontiguousarray(fov.crop(synthetic.view(img, fov, x, y, seed=k))) for k, (x, y) in enumerate(places)]
    crops = spark.createDataFrame([(k, v.shape[1], v.shape[0], bytearray(v.tobytes())) for k, v in enumerate(views)], "id long, width int, height int, data binary")
    settings = Settings(work_diameter=160, coarse_diameter=80, link_min_content=0.0)
    found = SparkMatcher(crops, fov, settings).screen([0, 1, 2, 3], [4])
    assert {"i", "j", "ncc"} <= set(found.columns) and set(found["j"]) <= {4} and len(found) <= 3
