"""Frames from image sequences, by Spark's image reader, and into tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from petroloom import schema


def image_sequence(spark: SparkSession, folder: str, video_id: str = "video", fps: float = 30.0) -> DataFrame:
    """Frames (schema.FRAMES) of a folder of images, in order of their names. Rates that make no sense
    are taken as 30. Numbering orders the names alone, not the pixels."""
    fps = fps if 0 < fps <= 1000 and np.isfinite(fps) else 30.0
    img = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*").filter("nChannels = 3")
    names = img.select("origin").withColumn("frame_index", (F.row_number().over(Window.orderBy("origin")) - 1).cast("long"))
    return img.join(names, "origin").select(F.lit(video_id).alias("video_id"), "frame_index", (F.col("frame_index") / fps).alias("time_s"), "width", "height", "data")


def from_arrays(spark: SparkSession, frames: list[np.ndarray], video_id: str = "video", fps: float = 30.0) -> DataFrame:
    """Frames of BGR arrays, for tests and small inputs."""
    rows = [(video_id, k, k / fps, f.shape[1], f.shape[0], np.ascontiguousarray(f).tobytes()) for k, f in enumerate(frames)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.FRAMES.split(", ")]), schema.FRAMES)
