"""From frames to mosaics and reports."""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from petroloom.functions import blend, draw, fov as fv, imaging as im
from petroloom.operators.graph import cut, shared_folder
from petroloom.plans import keyframes as kf, mosaic
from petroloom.plans.control import cancellable
from petroloom.plans.matching import SparkMatcher
from petroloom.plans.posegraph import MATCH, PoseGraph
from petroloom.settings import Settings

POSITIONS = ["keyframe", "frame", "time_s", "x", "y", "rotation_deg", "quality", "n_links", "sharpness", "segment", "component", "status"]
LINKS = ["attempt", "segment_size", "source", "status", "main_kf", "seg_kf", "main_frame", "seg_frame", "ncc", "second_peak", "quality", "overlap", "tx", "ty", "rot_deg", "residual_px", "preview"]


@dataclass
class Result:
    out: str
    fov: fv.FieldOfView
    keyframes: pd.DataFrame
    poses: np.ndarray
    component: np.ndarray
    mosaics: dict[int, dict] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def detect_fov(frames: DataFrame, margin: float = 0.04, n: int = 15) -> fv.FieldOfView:
    """The field of view from n frames spread over the stream: each partition sends its brightest image."""
    total = frames.agg(F.max("frame_index")).first()[0]
    wanted = sorted({int(k * total / max(n - 1, 1)) for k in range(n)})

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            most = fv.brightest(kf.image(d, w, h) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True))
            if most is not None:
                yield pd.DataFrame({"h": [most.shape[0]], "w": [most.shape[1]], "most": [most.astype(np.float32).tobytes()]})

    parts = frames.filter(F.col("frame_index").isin(wanted)).select("width", "height", "data").mapInPandas(run, "h int, w int, most binary").collect()
    if not parts:
        raise ValueError("no frames")
    return fv.detect(np.maximum.reduce([np.frombuffer(r["most"], np.float32).reshape(r["h"], r["w"]) for r in parts]), margin)


def crops_of(frames: DataFrame, ids: pd.DataFrame, fov: fv.FieldOfView) -> DataFrame:
    """(id, width, height, data) of keyframes (id, frame_index)."""
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            parts = [np.ascontiguousarray(fov.crop(kf.image(d, w, h))) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "width": [p.shape[1] for p in parts], "height": [p.shape[0] for p in parts], "data": [p.tobytes() for p in parts]})

    named = frames.sparkSession.createDataFrame(ids[["id", "frame_index"]].astype("int64"), "id long, frame_index long")
    return frames.join(F.broadcast(named), "frame_index").select("id", "width", "height", "data").mapInPandas(run, "id long, width int, height int, data binary")


def cached(crops: DataFrame, settings: Settings) -> tuple[DataFrame, str]:
    """The crops as a table that the later stages read: in cache_dir, which stays, or else in the shared
    folder, from where it goes at the end unless keep_cache is set."""
    spark = crops.sparkSession
    at = f"{settings.cache_dir or shared_folder(spark)}/crops-{uuid.uuid4().hex}"
    crops.write.parquet(at)
    return spark.read.schema(crops.schema).parquet(at), at


def dropped(spark, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def flat_field(crops: DataFrame, ids: list[int], mask: np.ndarray, dark: float, most: int = 160, block: int = 512) -> np.ndarray | None:
    """blend.flat_field of small copies of the crops of all ids, by blocks of pixels: no task holds all copies."""
    if len(ids) < 8:
        return None

    def cut_up(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True):
                t = np.rint(im.resize(kf.image(d, w, h), min(1.0, most / max(w, h)))).astype(np.uint8)
                flat = t.reshape(-1, 3)
                at = range(0, len(flat), block)
                yield pd.DataFrame({"block": [x // block for x in at], "level": blend.least_level(t, mask, dark), "pixels": [flat[x : x + block].tobytes() for x in at]})

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["block"].iloc[0])
        pixels = np.stack([np.frombuffer(x, np.uint8).reshape(-1, 3) for x in pdf["pixels"]])
        valid, out = blend.middles(pixels, pdf["level"].to_numpy(), mask.ravel()[k * block : (k + 1) * block])
        return pd.DataFrame({"block": [k], "valid": [valid.tobytes()], "middle": [out.tobytes()]})

    kept = crops.sparkSession.createDataFrame([(int(x),) for x in ids], "id long")
    blocks = crops.join(F.broadcast(kept), "id", "left_semi").mapInPandas(cut_up, "block int, level double, pixels binary")
    rows = sorted(blocks.groupBy("block").applyInPandas(middle, "block int, valid binary, middle binary").collect(), key=lambda r: r["block"])
    return blend.gain_of(np.concatenate([np.frombuffer(r["valid"], bool) for r in rows]), np.concatenate([np.frombuffer(r["middle"]).reshape(-1, 3) for r in rows]), mask)


def levelled(poses: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Each component turned by its mean angle, so that it stands upright."""
    out = poses.copy()
    for c in np.unique(component[component >= 0]):
        mine = component == c
        mean = float(np.mean(poses[mine, 2]))
        cos, sin = math.cos(-mean), math.sin(-mean)
        out[mine, 0], out[mine, 1] = cos * poses[mine, 0] - sin * poses[mine, 1], sin * poses[mine, 0] + cos * poses[mine, 1]
        out[mine, 2] = poses[mine, 2] - mean
    return out


def positions(keyframes: pd.DataFrame, poses: np.ndarray, component: np.ndarray, quality: np.ndarray, links: np.ndarray, origins: dict[int, tuple[int, int]]) -> pd.DataFrame:
    """The report of frame positions, relative to each mosaic's corner."""
    def number(v: float, digits: int) -> str:
        return "" if v is None or not np.isfinite(v) else f"{v:.{digits}f}"

    rows = []
    for k, r in enumerate(keyframes.itertuples(index=False)):
        c = int(component[k])
        ox, oy = origins.get(c, (0, 0))
        placed = c >= 0
        rows.append((r.id, r.frame_index, number(r.time_s, 3), number(poses[k, 0] - ox, 2) if placed else "", number(poses[k, 1] - oy, 2) if placed else "", number(math.degrees(poses[k, 2]), 4) if placed else "", number(quality[k], 4), int(links[k]), number(r.sharpness, 1), r.segment, c if placed else "", "used" if c == 0 else "unlinked" if placed else "dropped"))
    return pd.DataFrame(rows, columns=POSITIONS)


def run(frames: DataFrame, out: str, settings: Settings = Settings(), fov: fv.FieldOfView | None = None, fps: float = 30.0, progress: Callable[[float, str], None] | None = None, cancelled: Callable[[], bool] | None = None) -> Result:
    """Builds the mosaics of one video's frames (schema.FRAMES) in the folder out. Once cancelled() says so, the jobs
    that run are interrupted and InterruptedError is raised."""
    with cancellable(frames.sparkSession, cancelled):
        return _run(frames, out, settings, fov, fps, progress, cancelled)


def _run(frames: DataFrame, out: str, settings: Settings, fov: fv.FieldOfView | None, fps: float, progress: Callable[[float, str], None] | None, cancelled: Callable[[], bool] | None) -> Result:
    def tell(share: float, what: str) -> None:
        if cancelled and cancelled():
            raise InterruptedError(what)
        if progress:
            progress(share, what)

    os.makedirs(out, exist_ok=True)
    fov = fov or detect_fov(frames, settings.mask_margin)
    first = frames.orderBy("frame_index").limit(1).collect()
    if not first:
        raise ValueError("no frames")
    mosaic.jpeg(frames.sparkSession, draw.field_of_view(kf.image(first[0]["data"], first[0]["width"], first[0]["height"]), fov), f"{out}/fov.jpg", settings.jpeg_quality)
    tell(0.05, "tracking")
    events = cut(kf.select(frames, fov, settings, fps))
    keyframes = events.filter("event = 'keyframe'").select("id", "frame_index", "time_s", "segment", "sharpness").orderBy("id").toPandas()
    if not len(keyframes):
        raise ValueError("no usable frame")
    edges = events.filter("event = 'edge'").select(*[c for c in MATCH if c != "second"], F.lit("seq").alias("kind")).orderBy("j").toPandas()
    crops, cache = cached(crops_of(frames, keyframes, fov), settings)
    try:
        tell(0.45, "pose graph")
        graph = PoseGraph(keyframes, edges, SparkMatcher(crops, fov, settings), settings, fov.diameter, cancelled=cancelled).run()
        if not (graph.component == 0).any():
            raise ValueError("no frame could be placed")
        poses = levelled(graph.poses, graph.component)
        placed = keyframes["id"][graph.component >= 0].tolist()
        gain = flat_field(crops, placed, im.resize(fov.mask().astype(np.float32), min(1.0, 160 / max(fov.size()))) > 0.5, settings.link_dark_level) if settings.flat_field else None
        result = Result(out, fov, keyframes, poses, graph.component, {}, graph.log, graph.warnings)
        tell(0.6, "rendering")
        table = keyframes.assign(x=poses[:, 0], y=poses[:, 1], theta=poses[:, 2], component=graph.component)
        for c in sorted(set(graph.component[graph.component >= 0].tolist())):
            tell(0.6, "rendering")
            render_component(result, crops, table, int(c), settings, gain)
        quality, links = graph.frame_quality()
        origins = {c: m["origin"] for c, m in result.mosaics.items()}
        positions(keyframes, poses, graph.component, quality, links, origins).to_csv(f"{out}/frame_positions.csv", index=False)
        if settings.link_diagnostics:
            records = graph.link_records().rename(columns={"i": "main_kf", "j": "seg_kf", "second": "second_peak", "residual": "residual_px"})
            if "theta" in records:
                records["rot_deg"] = np.degrees(records["theta"].astype(float))
            previews(records, crops, fov, out)
            records.reindex(columns=LINKS).to_csv(f"{out}/segment_links.csv", index=False, float_format="%.4f")
        if settings.keep_merge_data:
            save_state(result, crops, table.assign(quality=quality, n_links=links), settings, gain)
        with open(f"{out}/log.txt", "w") as f:
            f.write("\n".join([*result.log, *result.warnings, settings.to_json()]) + "\n")
    finally:
        if not settings.keep_cache and not settings.cache_dir:
            dropped(frames.sparkSession, cache)
    tell(1.0, "done")
    return result


def previews(records: pd.DataFrame, crops: DataFrame, fov: fv.FieldOfView, out: str, most: int = 120) -> None:
    """Pictures of the first `most` link records, named in their `preview`."""
    if not len(records):
        return
    records["preview"] = ""
    some = records.head(most)
    ids = sorted({int(x) for c in ("main_kf", "seg_kf") for x in some[c]})
    img = {r["id"]: kf.image(r["data"], r["width"], r["height"]) for r in crops.filter(F.col("id").isin(ids)).collect()}
    os.makedirs(f"{out}/links", exist_ok=True)
    for k, r in some.iterrows():
        name = f"links/{int(r['attempt']):03d}_{int(r['main_kf'])}_{int(r['seg_kf'])}_{r['status']}.jpg"
        mosaic.jpeg(crops.sparkSession, draw.overlay(img[int(r["main_kf"])], img[int(r["seg_kf"])], fov, r["dx"], r["dy"], r["phi"]), f"{out}/{name}")
        records.loc[k, "preview"] = name


def render_component(result: Result, crops: DataFrame, table: pd.DataFrame, c: int, settings: Settings, gain: np.ndarray | None) -> None:
    mine = table[table["component"] == c]
    name, preview = ("mosaic", "preview.jpg") if c == 0 else (f"unlinked/component_{c:02d}", f"unlinked/component_{c:02d}_preview.jpg")
    os.makedirs(os.path.dirname(f"{result.out}/{name}"), exist_ok=True)
    ox, oy, *_ = mosaic.extent(mine, result.fov)
    size = mosaic.save(mosaic.tiles(crops, mine, result.fov, settings, gain), f"{result.out}/{name}.tif.part", settings, f"{result.out}/{preview}")
    os.replace(f"{result.out}/{name}.tif.part", f"{result.out}/{name}.tif")
    result.mosaics[c] = {"tiff": f"{name}.tif", "origin": (ox, oy), "size": size}


def save_state(result: Result, crops: DataFrame, table: pd.DataFrame, settings: Settings, gain: np.ndarray | None) -> None:
    """What a later session needs to attach leftover components by hand."""
    to = f"{result.out}/merge"
    os.makedirs(to, exist_ok=True)
    crops.write.mode("overwrite").parquet(f"{to}/crops.parquet")
    if gain is not None:
        np.save(f"{to}/gain.npy", gain)
    state = {"version": 1, "fov": asdict(result.fov), "settings": json.loads(settings.to_json()), "frames": json.loads(table.to_json(orient="records")), "outputs": {str(c): m for c, m in result.mosaics.items()}, "merges": []}
    write_state(to, state)


def write_state(folder: str, state: dict) -> None:
    """All or nothing: written beside and moved over."""
    with open(f"{folder}/state.json.tmp", "w") as f:
        json.dump(state, f)
    os.replace(f"{folder}/state.json.tmp", f"{folder}/state.json")
