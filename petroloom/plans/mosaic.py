"""Rendering of mosaics, tile by tile.

Frames are joined to the tiles that they touch; each tile is blended by one task, which holds the few frames
that overlap there. Compressed tiles are a table, whose tasks write them into the file at their places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from petroloom.functions import blend, imaging as im
from petroloom.functions.fov import FieldOfView
from petroloom.operators import graph
from petroloom.operators.spatial import covered_tiles
from petroloom.plans.keyframes import image
from petroloom.settings import Settings
from petroloom.sources import mosaic_file, tiff

CELL = 256
TILES = "number long, x long, y long, data binary, small binary, sw int, sh int"


def extent(poses: pd.DataFrame, fov: FieldOfView) -> tuple[int, int, int, int]:
    """Origin and size of the mosaic of poses (x, y)."""
    r = fov.r_eff + 2
    x0, y0 = int(np.floor(poses["x"].min() - r)), int(np.floor(poses["y"].min() - r))
    return x0, y0, int(np.ceil(poses["x"].max() + r)) - x0 + 1, int(np.ceil(poses["y"].max() + r)) - y0 + 1


def tiles(crops: DataFrame, poses: pd.DataFrame, fov: FieldOfView, settings: Settings, gain: np.ndarray | None = None) -> tuple[DataFrame, int, int]:
    """The tiles (TILES) of the mosaic of crops (id, width, height, data) at poses (id, x, y, theta), and its size.
    `gain`, a small image, is sent with the task."""
    spark, (ox, oy, width, height) = crops.sparkSession, extent(poses, fov)
    step = max(CELL, settings.tile_size // CELL * CELL)
    pad = 4 * 2**settings.blend_levels if settings.blending == "multiband" else 0
    across, r = -(-width // CELL), fov.r_eff
    share = min(1.0, settings.preview_max_size / max(width, height))
    weight, centre = blend.edge_weight(fov.mask(shrink=2)), fov.centre()

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf["tile_x"].iloc[0]) * step, int(pdf["tile_y"].iloc[0]) * step
        w, h = min(step, width - tx), min(step, height - ty)
        layers = []
        for f in pdf.sort_values("id").itertuples(index=False):
            img = image(f.data, f.width, f.height).astype(np.float32)
            if gain is not None:
                g = np.stack([im.sample(gain[..., k], *np.meshgrid(*((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((f.width, gain.shape[1]), (f.height, gain.shape[0])))), 1.0) for k in range(3)], axis=2)
                img = np.clip(img * g, 0, 255)
            layers.append(blend.warp(img, weight, (f.x - ox, f.y - oy, f.theta), centre, tx - pad, ty - pad, w + 2 * pad, h + 2 * pad, settings.interpolation))
        if settings.blending == "multiband":
            out = blend.multiband(layers, settings.blend_levels)
        else:
            out = blend.simple(layers, None if settings.blending == "none" else settings.feather_power)
        out = out[pad : pad + h, pad : pad + w]
        rows = []
        for y in range(0, h, CELL):
            for x in range(0, w, CELL):
                part = out[y : y + CELL, x : x + CELL]
                small = im.resize(part, share) if share < 1 else part
                full = np.zeros((CELL, CELL, 3), np.uint8)
                full[: part.shape[0], : part.shape[1]] = part
                rows.append(((ty + y) // CELL * across + (tx + x) // CELL, tx + x, ty + y, tiff.packed(full, settings.tiff_compression == "zlib"), np.rint(small).astype(np.uint8).tobytes(), small.shape[1], small.shape[0]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TILES.split(", ")])

    at = spark.createDataFrame(poses[["id", "x", "y", "theta"]].astype({"id": "int64"}), "id long, x double, y double, theta double")
    low = lambda c, o: F.greatest(F.col(c) - r - o - pad, F.lit(0.0))
    high = lambda c, o, n: F.least(F.col(c) + r - o + pad + 1, F.lit(float(n)))
    boxes = at.withColumns({"x0": low("x", ox), "y0": low("y", oy), "x1": high("x", ox, width), "y1": high("y", oy, height)})
    placed = covered_tiles(boxes, float(step)).select("id", "x", "y", "theta", "tile_x", "tile_y").join(crops.select("id", "width", "height", "data"), "id")
    return placed.groupBy("tile_x", "tile_y").applyInPandas(render, TILES), width, height


def save(rendered: tuple[DataFrame, int, int], path: str, settings: Settings, preview: str | None = None) -> tuple[int, int]:
    """Writes the tiles into a TIFF file, each by the task that holds it, and smaller ones into a JPEG file of bounded
    size. Tiles are rendered once, into a table of the shared folder."""
    df, width, height = rendered
    kept = graph.stored(df)
    try:
        mosaic_file.write(kept.select("number", "data"), path, width, height, CELL, settings.tiff_compression == "zlib")
        if preview:
            share = min(1.0, settings.preview_max_size / max(width, height))
            small = np.zeros((max(1, int(np.ceil(height * share))) + CELL, max(1, int(np.ceil(width * share))) + CELL, 3), np.uint8)
            for t in kept.select("x", "y", "small", "sw", "sh").toLocalIterator():
                y, x = round(t["y"] * share), round(t["x"] * share)
                small[y : y + t["sh"], x : x + t["sw"]] = np.frombuffer(t["small"], np.uint8).reshape(t["sh"], t["sw"], 3)
            jpeg(df.sparkSession, small[: max(1, int(height * share)), : max(1, int(width * share))], preview, settings.jpeg_quality)
    finally:
        graph.forget(kept)
    return width, height


def jpeg(spark, bgr: np.ndarray, path: str, quality: int = 92) -> None:
    """Writes a small image with the JVM's encoder."""
    jvm = spark._jvm
    h, w = bgr.shape[:2]
    img = jvm.java.awt.image.BufferedImage(w, h, jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR)
    img.getRaster().getDataBuffer()
    packed = (bgr[..., 2].astype(np.int64) << 16 | bgr[..., 1].astype(np.int64) << 8 | bgr[..., 0]).astype(np.int32)
    raw = jvm.java.nio.ByteBuffer.wrap(bytearray(packed.astype(">i4").tobytes())).asIntBuffer()
    ints = spark.sparkContext._gateway.new_array(jvm.int, h * w)
    raw.get(ints)
    img.setRGB(0, 0, w, h, ints, 0, w)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    params = writer.getDefaultWriteParam()
    params.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
    params.setCompressionQuality(quality / 100)
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(path))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(img, None, None), params)
    out.close()
    writer.dispose()
